"""The simpler mergers of fragments."""

import pytest

from parlance.operators.merging import as_sentence, glued, merge, spaced

SCHEMA = "session_id long, sequence_id long, speaker_id string, text string, start_s double, end_s double, confidence double, is_partial boolean, processed_s double"


def run(spark, rule, *rows):
    given = [(1, k, *(r + (0.9, True, None) if len(r) == 4 else (None, None, None, None, None, None, r[0]))) for k, r in enumerate(rows)]
    return [(r.speaker_id, r.text) for r in merge(spark.createDataFrame(given, SCHEMA), rule).orderBy("utterance").collect()]


def test_texts():
    assert as_sentence(["I want this...", "For everyone", "and all"]) == "I want this for everyone and all."
    assert as_sentence(["Alone"]) == "Alone" and as_sentence(["I", "I'm here!"]) == "I I'm here!"
    assert spaced(["cut-", "off  here"]) == "cut off here" and glued(["cut-", "off", ", here"]) == "cut-off, here"


@pytest.mark.parametrize("rule", ["pause", "continuity"])
def test_open_fragments_go_on(spark, rule):
    learning = ("A", "I want this to be a learning experience", 0.0, 1.0), ("A", "for everyone.", 1.2, 2.0)
    assert run(spark, rule, *learning) == [("A", "I want this to be a learning experience for everyone.")]
    assert run(spark, rule, ("A", "The people I really admire", 1.0, 2.2), ("A", "are Michael Pollan.", 2.4, 3.3)) == [("A", "The people I really admire are Michael Pollan.")]
    assert run(spark, rule, learning[0], ("A", "for everyone.", 3.0, 4.0)) == [("A", learning[0][1]), ("A", "for everyone.")]
    assert run(spark, rule, learning[0], (1.2,), learning[1])[0][1].endswith("everyone.") and len(run(spark, rule, learning[0], (1.4,), learning[1])) == 2


@pytest.mark.parametrize("rule", ["pause", "continuity", "buffer"])
def test_nothing_is_lost_at_another_speaker(spark, rule):
    rows = ("A", "I was thinking of", 0.0, 1.0), ("B", "Yes.", 1.1, 1.5), ("A", " ", 1.5, 1.6), (None, None, 1.6, 1.7), ("A", "what you said.", 1.7, 2.0), (None, "Who is it?", 2.0, 3.0)
    assert run(spark, rule, *rows) == [("A", "I was thinking of"), ("B", "Yes."), ("A", "what you said."), ("unknown", "Who is it?")]
    assert run(spark, rule, ("A", " ", 0.0, 1.0)) == []


def test_groups_have_a_length(spark):
    long = " ".join(["and"] * 34)
    assert len(run(spark, "pause", ("A", long, 0.0, 1.0), ("A", "and", 1.0, 1.1), ("A", "and this.", 1.1, 1.2))) == 2


def test_a_buffer_ends_at_a_mark_or_a_pause(spark):
    assert run(spark, "buffer", ("A", "One", 0.0, 1.0), ("A", "two.", 2.0, 3.0), ("A", "three", 3.0, 4.0), ("A", "four", 6.0, 7.0), (8.0,), ("A", "five", 8.0, 9.0)) == [("A", "One two."), ("A", "three"), ("A", "four five")]
    with pytest.raises(ValueError):
        merge(spark.createDataFrame([], SCHEMA), "none")
