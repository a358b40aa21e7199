"""Recurrence decides about messages that only broad rules class, and telling of a message is content."""

import pytest

from palimpsest.llm import residue as R


@pytest.mark.parametrize(
    ("message", "kind"),
    [
        ("We could not load the requested page.", "error"), ("The request timed out.", "error"), ("Error reference AB-77.", "error"), ("Sample heading text", "filler"), ("The full text will follow.", "filler"), ("内容待补充。", "filler"), ("Reload once your browser runs scripts.", "scripts"),
    ],
)
def test_broad_rules_alone_do_not_count(message, kind):
    assert R.classify(message) == (kind, False)


@pytest.mark.parametrize(
    "message",
    [
        "If the panel shows error 503, call the crew chief.", "The word lorem ipsum was cut from the plate.", "Where the display reads Not Found (404), the card is loose.", "The reader works without scripts of any kind.",
        "A copy that was not found in the store may be ordered.", "The caption “Bad Request (400)” is explained in section 4.", "Reset the breaker and try the pump again.",
    ],
)
def test_telling_of_a_message_is_content(message):
    assert R.classify(message) == ("", False)


def test_lines_without_a_wrap_are_messages_of_their_own():
    text = "Outer Hook Gauge\nText goes here.\n\nBefore the pump is removed, drain it from the\naft valve. Then tag\nit.\nREV 4"
    assert R.messages(text) == ["Outer Hook Gauge", "Text goes here.", "Before the pump is removed, drain it from the aft valve.", "Then tag it.", "REV 4"]


def test_recurrence_decides(spark):
    message = "We could not load sheet {} of the document."
    rows = [(i, f"Heading {i}\n\n" + message.format(i), f"s{i % 3}") for i in range(4)]  # four documents of three sources, numbers aside one message
    rows += [(10, "Heading\n\nWe could not find the requested index.", "s1")]  # once
    rows += [(20 + i, "The request timed out.", "one") for i in range(9)]  # often, but from one source
    rows += [(40, "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", None), (41, "Drain ${limit} from the pump.", None)]  # strict rules
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "true AS wide", "1 AS n_docs")
    got = {(r.doc_id, r.kind) for r in R.residue(df, "doc_id", "text", "source").collect()}
    assert got == {(0, "error"), (1, "error"), (2, "error"), (3, "error"), (40, "filler"), (41, "placeholder")}
    wide = R.recurring(R.classed_messages(df, "doc_id", "text", "source")).filter("wide").collect()
    assert [(r.n_docs, r.n_sources, r.plain) for r in wide] == [(4, 3, False)]
