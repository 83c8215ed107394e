import datetime

import pytest

from turnlake.functions import render as R


def test_snippet_marks_and_edges():
    text = "word " * 60 + "needle" + " word" * 60
    out = R.snippet(text, 300, 6)
    assert "«needle»" in out and out.startswith("…word") and out.endswith("word…") and len(out.encode()) < 160
    assert R.snippet("é" * 200, 100, 2).count("«é»") == 1
    assert R.snippet("abc", 50, 9) == "abc"


def test_excerpt_sizes_words():
    assert R.excerpt("short", 0, 100) == "short"
    assert len(R.excerpt("é" * 500, 400, 99).encode()) <= 99 + 6
    assert R.byte_size(2048) == "2.0 KB" and R.plural(1, "turn") == "1 turn" and R.plural(2000, "turn") == "2,000 turns"
    assert R.shell_word("a b'c") == "'a b'\\''c'" and R.shell_word("a/b") == "a/b"
    assert R.token_estimate("\x1b[1mabcde\x1b[0m") == 2
    now = datetime.datetime(2026, 1, 3)
    assert R.ago(now, now) == "today" and R.ago(None, now) == "undated" and R.date_range(now, now) == "2026-01-03"


def test_too_large_is_refused():
    with pytest.raises(R.OutputTooLarge):
        R.capped("x" * 70_000)
