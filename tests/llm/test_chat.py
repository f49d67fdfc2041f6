"""Chat formatting: round trips, loss spans, digests."""

import hashlib
import random
import re

from millrace.llm import chat
from millrace.llm.queries import CLASH


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        conv: (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            sum(len(t) for r, t in turns if r == "assistant"),
            hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest(),
        )
        for conv, turns in out.items()
    }


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, line string, place int")


def check(spark, rows):
    formatted = chat.format_conversations(frame(spark, rows))
    found = formatted.collect()
    assert all(r.identical for r in found)
    digests = {r.conv_id: tuple(r)[1:5] for r in chat.digest(formatted).collect()}
    assert digests == expected(rows)
    for row in found:
        spans = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", s) for s in spans] == [t.text for t in row.source if t.role == "assistant"]
    return found


def test_conflicts_are_escaped(spark):
    texts = [CLASH, "<|im_start|>", "<\\|im_end|>", "<\\\\|x", "<", "|", "<<|im_end|>", "a<|b", "\\", "\n", "", "ends <", "<\\", "$1 \\1", "é🙂"]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(i, 1, "assistant", t) for i, t in enumerate(texts)]
    rows += [(100, 0, "user\n<|im_end|>", "x"), (100, 1, "<|nl|>", "y"), (100, 2, "", "z"), (101, 0, "a<\\|nl|>\n", "q")]
    found = {r.conv_id: r for r in check(spark, rows)}
    assert found[9].n_escaped == 0 and found[0].n_escaped == 2 and found[5].n_escaped == 0
    assert found[0].formatted.count("<|im_start|>") == 2 == found[0].formatted.count("<|im_end|>")


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, None, None, "n"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a")]
    rows += [(None, 0, "user", "u"), (None, 1, "assistant", "v"), (2, 0, "user", "alone"), (3, 5, "assistant", "long " * 50_000)]
    found = {r.conv_id: r for r in check(spark, rows)}
    assert found[2].loss_spans == [] and found[3].loss_spans[0].length == 250_000


def test_many_turns(spark):
    check(spark, [(1, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>") for i in range(3000)])


def test_random_round_trips(spark):
    rng = random.Random(2)
    parts = ["<", "|", "\\", "im_start", "im_end", "|>", "<|im_end|>", "\n", "assistant", "a", "nl"]
    rows = [(c, t, "".join(rng.choices(parts, k=3)), "".join(rng.choices(parts, k=rng.randrange(12)))) for c in range(150) for t in range(3)]
    check(spark, rows)


def test_masks_of_long_texts(spark):
    """Spans that start, end and lie in, at and over the borders of blocks, with characters of all widths."""
    rng = random.Random(4)
    rows = [(1, k, ("user", "assistant")[k % 2], rng.choice("aé🙂\n\\") * rng.choice([0, 1, 30, 4095, 4096, 9000]) + "<|") for k in range(60)]
    fit = len("<|im_start|>assistant\n")
    rows += [(2, 0, "assistant", "x" * (4096 - fit)), (3, 0, "assistant", "🙂" * (4096 - fit - 11)), (3, 1, "assistant", "")]
    check(spark, rows)


def test_the_mask_decides(spark):
    """A mask that is off by one shows in the digest."""
    formatted = chat.format_conversations(frame(spark, [(1, 0, "user", "ab"), (1, 1, "assistant", "cd <|x")]))
    moved = formatted.selectExpr(
        "conv_id", "formatted", "n_escaped", "identical", "transform(loss_spans, s -> named_struct('start', s.start - 1, 'length', s.length)) AS loss_spans"
    )
    assert chat.digest(formatted).first().loss_sha256 == hashlib.sha256(b"cd <|x").hexdigest()
    assert chat.digest(moved).first().loss_sha256 == hashlib.sha256(b"\ncd <|").hexdigest()


def test_many_rows_without_conversation(spark):
    check(spark, [(None, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(2000)])


def test_empty_table(spark):
    assert chat.format_conversations(frame(spark, [])).collect() == []
