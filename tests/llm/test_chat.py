"""Chat formatting: a plain fold in one process, round trips of texts that hold the template's own strings, and edge cases."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuswright.llm import chat
from corpuswright.llm.chat import Template

LOG = "conv_id long, message long, stream string, seq long, kind string, role string, text string"
FRAGMENTS = ["<", "[", "\\", "s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]", "ROLE]", ":]", "/ROLE]", " ", "\n", "é🙂", "[INST] ", "</s>"]
TEXT = st.lists(st.sampled_from(FRAGMENTS), max_size=10).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), TEXT), TEXT), max_size=5))
def test_what_is_rendered_reads_back(turns):
    template, out, learned = Template(), "", []
    for role, text in turns:
        rendered, start, stop = template.turn(role, text)
        if role == "assistant":
            learned.append((len(out) + start, len(out) + stop))
        out += rendered
    assert list(template.turns(out)) == turns
    assert [template.unescape(out[a:b]) for a, b in learned] == [t for r, t in turns if r == "assistant"]
    for text in (t for _, t in turns):
        escaped = template.escape(text)
        assert template.unescape(escaped) == text and not any(m in escaped for m in ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[:]"))


def plain(log):
    """Final (role, text) by conversation and message, event by event."""
    out = {}
    for conv, message, stream, seq, kind, role, text in sorted(set(log), key=lambda e: tuple((x is not None, x if x is not None else 0) for x in e)):
        m = out.setdefault(conv, {}).setdefault((message, stream), ["", ""])
        if kind == "open":
            m[0] = role or ""
        elif kind == "delta":
            m[1] += text or ""
        elif kind == "edit":
            m[1] = text or ""
        else:
            m[1] = ""
    return {c: [tuple(m) for m in ms.values()] for c, ms in out.items()}


def digest(turns):
    learned = [t for r, t in turns if r == "assistant"]
    text = "".join(Template().turn(*t)[0] for t in turns)
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len("".join(learned)), hashlib.sha256("".join(learned).encode()).hexdigest(), len(text))


@pytest.fixture(scope="module")
def log():
    rng = random.Random(5)
    rows = []
    for conv in [*range(12), None]:
        for message in range(rng.randint(1, 6)):
            seq = 0
            rows.append((conv, message, "s", seq, "open", rng.choice(["user", "assistant", "system", "tool", None]), None))
            for _ in range(rng.randint(0, 8)):
                seq += 1
                rows.append((conv, message, "s", seq, rng.choice(["delta", "delta", "delta", "edit", "regenerate"]), None, rng.choice([None, "", *FRAGMENTS, "some words "])))
    #: One of several blocks, and events that are delivered again, out of order.
    rows += [(99, i, "s", j, k, r, t) for i in range(-300, 700) for j, (k, r, t) in enumerate([("open", ("user", "assistant")[i % 2], None), ("delta", None, f"turn {i} "), ("delta", None, "</s>")])]
    rows += rng.sample(rows, 200)
    rng.shuffle(rows)
    return rows


def test_fold_equals_a_plain_fold(spark, log):
    table = spark.createDataFrame(log, LOG).withColumns({"block": F.lit("x"), "formatted": F.lit(1)}).repartition(5)
    chats = chat.format_chats(table)
    assert chats.filter("conv_id = 99").count() == 5
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chats).collect()}
    assert got == {c: digest(turns) for c, turns in plain(log).items()}


def test_derived_logs_end_as_the_tables_turns(spark):
    rows = [(1, 0, "user", "hello [INST] there"), (1, 1, "assistant", "x" * 3001), (1, 1, "assistant", "x" * 3001), (1, 2, None, None), (2, 0, "assistant", ""), (2, None, "user", "first"), (None, 3, "tool", "\\ </s>"), (3, 7, "user", "🙂" * 900), (3, 1, "assistant", "a\nb")]
    want = {1: [("user", rows[0][3]), ("assistant", "x" * 3001), ("assistant", "x" * 3001), ("", "")], 2: [("user", "first"), ("assistant", "")], None: [("tool", "\\ </s>")], 3: [("assistant", "a\nb"), ("user", "🙂" * 900)]}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in chat.chat_digests(table).collect()}
    assert got == {c: digest(t) for c, t in want.items()}
    kinds = {r.kind for r in chat.events(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate"}
    assert chat.chat_digests(table.limit(0)).count() == 0
