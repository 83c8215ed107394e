import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from turnlake import schema as S
from turnlake.functions.text import fold_text
from turnlake.plans.compile import QueryError, check_options, compile_query, parse_when, split_terms, stem, tiers_of


def texts(q):
    return [t.text for t in q.terms]


def test_split_terms():
    assert split_terms('a "b c" d') == [("a", False), ("b c", True), ("d", False)]
    assert split_terms('x "open to the end') == [("x", False), ("open to the end", True)]
    assert split_terms('a""b') == [("a", False), ("b", False)]


@pytest.mark.parametrize("word, cut", [("things", "thing"), ("queries", "quer"), ("running", "runn"), ("bed", "bed"), ("hits", "hits"), ("boxes", "boxe"), ("early", "earl")])
def test_stem(word, cut):
    assert stem(word) == cut


def test_stopwords_need_three_terms_and_leave_two():
    q = compile_query("the thing of ershe")
    assert texts(q) == ["thing", "ershe"] and q.dropped == ("the", "of")
    assert texts(compile_query("the thing")) == ["the", "thing"]
    assert texts(compile_query("the of thing")) == ["the", "of", "thing"]
    assert texts(compile_query('"the" thing ershe')) == ["the", "thing", "ershe"]


def test_terms_count_once_and_synonyms():
    assert texts(compile_query("Thing thing")) == ["thing"]
    t = compile_query("repository").terms[0]
    assert t.synonyms == ("repo",)
    assert compile_query("config").terms[0].synonyms == ("configuration",)
    assert compile_query("configuration").terms[0].synonyms == ("config", "cfg")
    assert compile_query("repository", exact=True).terms[0].synonyms == ()


def test_fixed_values():
    assert len(S.STOPWORDS) == 96 and len(S.SYNONYM_PAIRS) == 27 and len(S.KNOWN_TYPES) == 20 and len(S.WIDTH_CHANGING) == 27


def test_tiers_times_options():
    assert tiers_of() == ("conversation",) and tiers_of(results=True) == ("conversation", "result")
    now = datetime.datetime(2026, 1, 31, tzinfo=datetime.UTC)
    assert parse_when("1m", now) == datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    assert parse_when("2026-08-01").hour == 0
    for bad in ("soon", "5x"):
        with pytest.raises(QueryError):
            parse_when(bad)
    with pytest.raises(QueryError):
        check_options(limit=0)


@given(st.text())
def test_fold_keeps_bytes(text):
    assert len(fold_text(text).encode("utf-8", "surrogatepass")) == len(text.encode("utf-8", "surrogatepass"))
