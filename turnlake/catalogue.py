"""One query for each operator family of the engine, over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import text as X
from .functions.render import OWN_MARK
from .operators import context, filters, matching, ranking, survey
from .operators.filters import TurnFilter
from .plans.compile import CompiledQuery, compile_query
from .sources.tables import TURNS3_SQL, table, turns3

CONV = ("conversation",)
MIXED = "thing ershe zzqq"
PAIR = "thing ershe"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL over ``turns`` if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = "WITH " + TURNS3_SQL.strip() + sql if "FROM turns" in sql or "m_conv" in sql else sql
        return f

    return add


def slim(df: DataFrame) -> DataFrame:
    return df.select("session", "uuid", "tier")


def search(spark: SparkSession, sf_dir: str, text: str, tiers: tuple[str, ...] = CONV, f: TurnFilter | None = None, **how) -> tuple[DataFrame, CompiledQuery]:
    """Hits of a query over the test turns, deduplicated."""
    q = compile_query(text, tiers=tiers, **how)
    turns = filters.keep(turns3(spark, sf_dir, tiers), f or TurnFilter())
    found = matching.Relaxed(turns, q)
    return matching.dedup(matching.hits(found.turns, q)).persist(), q


# --- scans and filters


@query("""SELECT tier, count(*)::BIGINT AS turns, count(DISTINCT session)::BIGINT AS sessions, sum(strlen(text))::BIGINT AS bytes FROM turns GROUP BY tier""")
def scan_tiers(spark, sf_dir):
    return turns3(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("turns"), F.count_distinct("session").alias("sessions"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("""SELECT session, uuid, tier FROM turns WHERE tier IN ('conversation', 'invocation')""")
def filter_tiers(spark, sf_dir):
    return slim(filters.tiers(turns3(spark, sf_dir), ("conversation", "invocation")))


@query("""SELECT session, uuid, tier FROM turns WHERE repo = 'ACME/pay' OR contains(lower(repo), 'acme/pay')""")
def filter_scope_repo(spark, sf_dir):
    return slim(turns3(spark, sf_dir).where(filters.in_scope("ACME/pay")))


@query("""SELECT session, uuid, tier FROM turns WHERE author = 'human'""")
def filter_author(spark, sf_dir):
    return slim(filters.keep(turns3(spark, sf_dir), TurnFilter(author="human")))


@query("""SELECT session, uuid, tier FROM turns WHERE lower(branch) = 'hotfix/dedupe'""")
def filter_branch_ci(spark, sf_dir):
    return slim(filters.keep(turns3(spark, sf_dir), TurnFilter(branch="HOTFIX/dedupe")))


@query("""SELECT session, uuid, tier FROM turns WHERE contains(lower(agent), 'explor')""")
def filter_agent_contains(spark, sf_dir):
    return slim(filters.keep(turns3(spark, sf_dir), TurnFilter(agent="eXplor")))


@query("""SELECT session, uuid, tier FROM turns WHERE starts_with(session, 'c00001')""")
def filter_session_prefix(spark, sf_dir):
    return slim(filters.keep(turns3(spark, sf_dir), TurnFilter(session="c00001")))


SINCE, UNTIL = (datetime.datetime(2024, 1, d, tzinfo=datetime.UTC) for d in (10, 25))


@query("""SELECT session, uuid, tier FROM turns WHERE ts = '' OR (ts >= '2024-01-10T00:00:00Z' AND ts <= '2024-01-25T00:00:00Z')""")
def filter_time_undated(spark, sf_dir):
    return slim(filters.keep(turns3(spark, sf_dir), TurnFilter(since=SINCE, until=UNTIL)))


@query("""SELECT reason, count(*)::BIGINT AS turns FROM (SELECT CASE WHEN author <> 'assistant' THEN 'author' WHEN lower(branch) <> 'main' THEN 'branch' WHEN session = 'c000003' THEN 'self' WHEN ts < '2024-01-10T00:00:00Z' AND ts <> '' THEN 'since' END AS reason FROM turns) WHERE reason IS NOT NULL GROUP BY reason""")
def filter_drop_reason(spark, sf_dir):
    return filters.dropped(turns3(spark, sf_dir), TurnFilter(author="assistant", branch="main", self_session="c000003", drop_own_output=True, since=SINCE))


MARKED = "CASE WHEN length(text) % 3 = 0 THEN '{mark}' || chr(10) || text WHEN length(text) % 3 = 1 THEN 'cd x && turnlake find ' || text ELSE '/bin/turnlake find ' || text END"


@query(f"""SELECT session, uuid, tier FROM turns WHERE NOT ((tier = 'result' AND length(text) % 3 = 0) OR (tier = 'invocation' AND length(text) % 3 = 1))""")
def filter_own_output(spark, sf_dir):
    marked = turns3(spark, sf_dir).withColumn("text", F.expr(MARKED.format(mark=OWN_MARK).replace("chr(10)", "char(10)")))
    return slim(marked.where(~filters.own_output()))


@query("""SELECT session, uuid, tier FROM turns WHERE tier = 'conversation' AND contains(folded, 'thing') AND NOT contains(folded, 'ershe') AND NOT contains(folded, 'of the')""")
def filter_not_terms(spark, sf_dir):
    q = compile_query("thing", exclude=["ershe", '"of the"'], tiers=CONV)
    return slim(matching.matched(turns3(spark, sf_dir, CONV), q))


# --- matching


@query("""SELECT session, uuid, tier FROM turns WHERE tier = 'conversation' AND contains(folded, 'ershe')""")
def match_single(spark, sf_dir):
    return slim(matching.matched(turns3(spark, sf_dir, CONV), compile_query("ershe", tiers=CONV)))


@query("""SELECT session, uuid, tier FROM turns WHERE contains(folded, 'thing')""")
def match_all_tiers(spark, sf_dir):
    return slim(matching.matched(turns3(spark, sf_dir), compile_query("thing", tiers=S.TIERS)))


@query("""SELECT session, uuid, tier FROM turns WHERE tier = 'conversation' AND contains(folded, 'thing')""")
def match_stem(spark, sf_dir):
    return slim(matching.matched(turns3(spark, sf_dir, CONV), compile_query("things", tiers=CONV)))


@query("""SELECT session, uuid, tier FROM turns WHERE tier = 'conversation' AND contains(folded, 'things')""")
def match_exact(spark, sf_dir):
    return slim(matching.matched(turns3(spark, sf_dir, CONV), compile_query("things", tiers=CONV, exact=True)))


@query("""SELECT session, uuid, tier FROM turns WHERE tier = 'conversation' AND contains(folded, 'of the')""")
def match_phrase(spark, sf_dir):
    return slim(matching.matched(turns3(spark, sf_dir, CONV), compile_query('"of the"', tiers=CONV)))


@query(r"""SELECT session, uuid, tier FROM (SELECT *, lower(replace(text, 'he', 'id')) AS t FROM turns) WHERE contains(t, 'identifier') OR regexp_matches(t, '(^|[^a-z\x{80}-\x{10ffff}])id($|[^a-z\x{80}-\x{10ffff}])')""")
def match_synonym_word(spark, sf_dir):
    rows = turns3(spark, sf_dir).withColumn("text", F.replace("text", F.lit("he"), F.lit("id")))
    return slim(rows.where(matching.satisfied(X.fold(F.col("text")), compile_query("identifier").terms[0])))


FOUND_SQL = "SELECT session, uuid, tier, text, folded, author, agent, ts, repo, branch, contains(folded, 'thing')::INT + contains(folded, 'ershe')::INT + contains(folded, 'zzqq')::INT AS found FROM turns WHERE tier = 'conversation'"
RELAXED_SQL = f", f AS ({FOUND_SQL}), m AS (SELECT * FROM f WHERE found >= 1 AND found >= (SELECT max(found) FROM f) - 1)"


@query(RELAXED_SQL + " SELECT session, uuid, tier, found FROM m")
def match_relaxed(spark, sf_dir):
    q = compile_query(MIXED, tiers=CONV)
    return matching.Relaxed(turns3(spark, sf_dir, CONV), q).turns.select("session", "uuid", "tier", "found")


@query("""SELECT session, uuid, tier FROM turns WHERE tier = 'conversation' AND contains(folded, 'thing') AND contains(folded, 'ershe')""")
def match_all_terms(spark, sf_dir):
    q = compile_query(PAIR, tiers=CONV, all_terms=True)
    return slim(matching.Relaxed(turns3(spark, sf_dir, CONV), q).turns)


@query(RELAXED_SQL + """ SELECT term, carried FROM (SELECT coalesce(bool_or(contains(folded, 'thing')), false) AS thing, coalesce(bool_or(contains(folded, 'ershe')), false) AS ershe, coalesce(bool_or(contains(folded, 'zzqq')), false) AS zzqq FROM m) UNPIVOT (carried FOR term IN (thing, ershe, zzqq))""")
def match_carried(spark, sf_dir):
    q = compile_query(MIXED, tiers=CONV)
    carried = matching.Relaxed(turns3(spark, sf_dir, CONV), q).carried()
    return spark.createDataFrame([(t.text, t.text in carried) for t in q.terms], "term string, carried boolean")


SPANS_SQL = r"""
, occ AS (
  SELECT session, uuid, tier, ts, author, agent, repo, branch, text, folded, found, needle, string_split(folded, needle) AS parts
  FROM m, (VALUES ('thing'), ('ershe'), ('zzqq')) n(needle) WHERE contains(folded, needle)
), at AS (SELECT *, unnest(range(1, len(parts))) AS i FROM occ
), placed AS (
  SELECT *, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(needle) AS p FROM at
), h AS (
  SELECT session, uuid, tier, ts, author, agent, repo, branch, text, found, strlen(substr(text, 1, p::INT))::INT AS "offset", strlen(needle)::INT AS "length",
    CASE WHEN lead AND trail THEN 'word' WHEN lead THEN 'prefix' ELSE 'inside' END AS "match"
  FROM (SELECT *,
    (p = 0 OR NOT regexp_matches(substr(folded, p, 1), '[a-z0-9\x{80}-\x{10ffff}]') OR regexp_matches(substr(text, p, 3), '^([a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[0-9][A-Za-z]|[A-Za-z][0-9])')) AS lead,
    (p + length(needle) >= length(folded) OR NOT regexp_matches(substr(folded, p + length(needle) + 1, 1), '[a-z0-9\x{80}-\x{10ffff}]') OR regexp_matches(substr(text, p + length(needle), 3), '^([a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[0-9][A-Za-z]|[A-Za-z][0-9])')) AS trail
    FROM placed)
)
""".replace(", at AS", ", places AS").replace("FROM at\n", "FROM places\n")
HITS_SQL = RELAXED_SQL + SPANS_SQL


@query(HITS_SQL + """ SELECT session, uuid, tier, "offset", "length", "match", found AS terms FROM h""")
def hits_offsets(spark, sf_dir):
    found, _ = search(spark, sf_dir, MIXED)
    return found.select("session", "uuid", "tier", "offset", "length", "match", "terms")


@query(HITS_SQL + """ SELECT "match", author, count(*)::BIGINT AS hits FROM h GROUP BY "match", author""")
def hits_kind(spark, sf_dir):
    found, _ = search(spark, sf_dir, MIXED)
    return found.groupBy("match", "author").agg(F.count("*").alias("hits"))


@query(HITS_SQL + """ SELECT count(*)::BIGINT AS hits, count(*)::BIGINT AS redundant FROM h""")
def hits_dedup(spark, sf_dir):
    q = compile_query(MIXED, tiers=CONV)
    once = matching.hits(matching.Relaxed(turns3(spark, sf_dir, CONV), q).turns, q)
    twice = once.unionByName(once)
    kept = matching.dedup(twice).agg(F.count("*").alias("hits"))
    return kept.crossJoin(twice.agg(F.count("*").alias("all"))).select("hits", (F.col("all") - F.col("hits")).alias("redundant"))


KIND_ROWS = ["rateLimiter", "limiter", "HTTPLimiter x", "limiters", "unlimiter", "limiter2", "2limiter", "élimiter", "my_limiter_x", "limiterlimiter"]


@query("""SELECT * FROM (VALUES ('rateLimiter', 4, 'word'), ('limiter', 0, 'word'), ('HTTPLimiter x', 4, 'word'), ('limiters', 0, 'prefix'), ('unlimiter', 2, 'inside'), ('limiter2', 0, 'word'), ('2limiter', 1, 'word'), ('élimiter', 2, 'inside'), ('my_limiter_x', 3, 'word'), ('limiterlimiter', 0, 'prefix'), ('limiterlimiter', 7, 'inside')) v(text, "offset", "match")""")
def hits_case_boundary(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in KIND_ROWS], "text string")
    return rows.select("text", F.explode(X.spans(F.col("text"), X.fold(F.col("text")), "limiter")).alias("s")).select("text", "s.offset", "s.match")


@query("""SELECT doc_id, sha256(lower(text)) AS folded, strlen(text)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL""")
def fold_width(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(X.fold(F.col("text")), 256).alias("folded"), F.octet_length(X.fold(F.col("text"))).cast("long").alias("bytes"))


# --- survey


@query("""SELECT term, turns FROM (SELECT count_if(contains(folded, 'thing'))::BIGINT AS thing, count_if(contains(folded, 'ershe'))::BIGINT AS ershe, count_if(contains(folded, 'zzqq'))::BIGINT AS zzqq FROM turns WHERE tier = 'conversation') UNPIVOT (turns FOR term IN (thing, ershe, zzqq))""")
def survey_terms(spark, sf_dir):
    q = compile_query(MIXED, tiers=CONV)
    counts = survey.term_turns(turns3(spark, sf_dir, CONV), q)
    return spark.createDataFrame([(t.text, n) for t, n in zip(q.terms, counts, strict=True)], "term string, turns long")


NEAR_SQL = r"""
, toks AS (SELECT unnest(regexp_extract_all(folded, '[a-z0-9\x{80}-\x{10ffff}]+')) AS token FROM turns WHERE tier = 'conversation'
), cand AS (SELECT token, count(*)::BIGINT AS n, levenshtein(token, 'thtqon')::INT AS distance FROM toks
  WHERE strlen(token) BETWEEN 4 AND 10 AND (starts_with(token, 'thtq') OR (abs(strlen(token) - 6) <= 2 AND levenshtein(token, 'thtqon') <= 2)) GROUP BY token
), near AS (SELECT *, row_number() OVER (ORDER BY distance, n DESC, token) AS place FROM cand)
"""


@query(NEAR_SQL + "SELECT 'thtqon' AS term, token, n, distance, place::INT AS place FROM near WHERE place <= 8")
def near_terms(spark, sf_dir):
    q = compile_query("thtqon", tiers=CONV)
    return survey.near_terms(turns3(spark, sf_dir, CONV), q, list(q.terms))


@query(NEAR_SQL + ", subs AS (SELECT token FROM near WHERE distance <= 1 AND place <= 4) SELECT session, uuid, tier FROM turns WHERE tier = 'conversation' AND EXISTS (SELECT 1 FROM subs WHERE contains(folded, token))")
def near_substitute(spark, sf_dir):
    q, turns = compile_query("thtqon", tiers=CONV), turns3(spark, sf_dir, CONV)
    words = survey.substitutes(survey.near_terms(turns, q, list(q.terms)))
    return slim(matching.Relaxed(turns, q.widened(words)).turns)


@query(r"""SELECT sum(strlen(text))::BIGINT AS bytes, count(*)::BIGINT AS turns, sum(len(text) - len(replace(text, chr(10), '')))::BIGINT AS lines, sum(len(regexp_extract_all(text, '[^ \t\n\r]+')))::BIGINT AS words FROM turns WHERE tier IN ('conversation', 'result')""")
def work_counters(spark, sf_dir):
    return matching.work(turns3(spark, sf_dir), compile_query("x", tiers=("conversation", "result")))


@query("""SELECT count(*)::BIGINT AS turns, count(DISTINCT session)::BIGINT AS sessions, count_if(tier <> 'invocation')::BIGINT AS turns_searched, count(DISTINCT CASE WHEN tier <> 'invocation' THEN session END)::BIGINT AS sessions_searched FROM turns""")
def coverage_counters(spark, sf_dir):
    return matching.coverage(turns3(spark, sf_dir), compile_query("x", tiers=("conversation", "result")))


@query("""SELECT session, count(*)::BIGINT AS turns FROM turns WHERE tier = 'conversation' GROUP BY session""")
def session_turn_counts(spark, sf_dir):
    return matching.turn_counts(turns3(spark, sf_dir))


# --- ranking

RANK_SQL = HITS_SQL.replace("WHERE tier = 'conversation'", "") + r"""
, ranked AS (SELECT *, CASE "match" WHEN 'word' THEN 2 WHEN 'prefix' THEN 1 ELSE 0 END AS kr FROM h
), tw AS (SELECT session, uuid, tier, ts, author, repo, branch, found, "offset", "match", kr, strlen(text) AS nb,
    count(*) OVER (PARTITION BY session, uuid, tier) AS occurrences,
    row_number() OVER (PARTITION BY session, uuid, tier ORDER BY kr DESC, "offset", "length") AS rn FROM ranked
), turnwise AS (SELECT session, uuid, tier, ts, author, repo, branch, "offset", "match", occurrences::BIGINT AS occurrences,
    found * (CASE WHEN author = 'system' THEN 0.25::DOUBLE ELSE 1 END) * (CASE "match" WHEN 'inside' THEN 0.30::DOUBLE WHEN 'prefix' THEN 0.85::DOUBLE ELSE 1 END) * 4000.0::DOUBLE / (4000 + nb) AS signal FROM tw WHERE rn = 1
), tc AS (SELECT session, count(*) AS turns FROM turns WHERE tier = 'conversation' GROUP BY session
), base AS (SELECT session, count(*)::BIGINT AS hits, count_if(author = 'agent')::BIGINT AS agent_hits, min(nullif(ts, '')) AS first, max(nullif(ts, '')) AS last, count(DISTINCT CASE WHEN tier = 'conversation' THEN uuid END) AS hit_turns FROM h GROUP BY session
), sess AS (SELECT base.*, coalesce(tc.turns, 0) > 0 AS turns_known, (CASE WHEN coalesce(tc.turns, 0) > 0 THEN greatest(tc.turns, hit_turns) ELSE hit_turns END)::BIGINT AS turns,
    (SELECT sum(signal) FROM turnwise WHERE turnwise.session = base.session) AS signal FROM base LEFT JOIN tc USING (session)
), sessions AS (SELECT *, signal / (turns + 20) AS score, first IS NOT NULL AS dated FROM sess)
"""


def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, MIXED, S.TIERS)[0]


def ranked_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sessions(ranked_hits(spark, sf_dir), matching.turn_counts(turns3(spark, sf_dir, CONV)))


@query(RANK_SQL + """SELECT session, uuid, tier, "offset", "match", occurrences, round(signal, 6) AS signal FROM turnwise""")
def turnwise_collapse(spark, sf_dir):
    return ranking.collapse(ranked_hits(spark, sf_dir)).select("session", "uuid", "tier", "offset", "match", "occurrences", F.round("signal", 6).alias("signal"))


@query(RANK_SQL + "SELECT author, tier, round(sum(signal), 5) AS signal FROM turnwise GROUP BY author, tier")
def signal(spark, sf_dir):
    return ranking.collapse(ranked_hits(spark, sf_dir)).groupBy("author", "tier").agg(F.round(F.sum("signal"), 5).alias("signal"))


SESSION_SQL = "SELECT session, hits, agent_hits, coalesce(first, '') AS first, coalesce(last, '') AS last, turns, turns_known, round(score, 6) AS score, row_number() OVER (ORDER BY {})::INT AS place FROM sessions QUALIFY place <= 10"


def _top(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    from pyspark.sql import Window

    rows = ranked_sessions(spark, sf_dir).withColumn("score", F.round("score", 6)).orderBy(*ranking.session_order(mode)).limit(10)  # the answer's ten
    shown = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*ranking.session_order(mode)))).select("session", "hits", "agent_hits", shown("first").alias("first"), shown("last").alias("last"), "turns", "turns_known", "score", "place")


@query(RANK_SQL + SESSION_SQL.format("dated DESC, turns_known DESC, round(score, 6) DESC, hits DESC, last DESC, session"))
def sessions_concentration(spark, sf_dir):
    return _top(spark, sf_dir, "concentration")


@query(RANK_SQL + SESSION_SQL.format("dated DESC, first, session"))
def sessions_chronological(spark, sf_dir):
    return _top(spark, sf_dir, "chronological")


@query(RANK_SQL + SESSION_SQL.format("dated DESC, last DESC, session"))
def sessions_recent(spark, sf_dir):
    return _top(spark, sf_dir, "recent")


@query(RANK_SQL + """, r AS (SELECT session, repo, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, (repo = '')::INT, repo) AS n FROM h GROUP BY session, repo), b AS (SELECT session, branch, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, (branch = '')::INT, branch) AS n FROM h GROUP BY session, branch) SELECT r.session, repo, branch FROM r JOIN b ON r.session = b.session AND r.n = 1 AND b.n = 1""")
def dominant_repo_branch(spark, sf_dir):
    found = ranked_hits(spark, sf_dir)
    return ranking.dominant(found, "repo").join(ranking.dominant(found, "branch"), "session").select("session", "repo", "branch")


@query(RANK_SQL + """SELECT field, value, count(*)::BIGINT AS hits, count(DISTINCT session)::BIGINT AS sessions FROM (SELECT session, unnest([{'field': 'repo', 'value': repo}, {'field': 'author', 'value': author}, {'field': 'tier', 'value': tier}, {'field': 'branch', 'value': branch}], recursive := true) FROM h) GROUP BY field, value""")
def facets(spark, sf_dir):
    return ranking.facets(ranked_hits(spark, sf_dir))


@query(RANK_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY (ts = '')::INT, ts, uuid, "offset", tier) AS pos FROM turnwise), w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY signal DESC, occurrences DESC, pos) AS worth FROM b) SELECT session, uuid, tier, pos::INT AS pos, occurrences FROM w WHERE worth <= 3""")
def best_hits_per_session(spark, sf_dir):
    return ranking.best_per_session(ranking.collapse(ranked_hits(spark, sf_dir)), 3).select("session", "uuid", "tier", "pos", "occurrences")


@query(RANK_SQL + """SELECT turnwise.session, uuid, tier, occurrences, round(turnwise.signal, 6) AS signal FROM turnwise JOIN sessions USING (session) ORDER BY turnwise.signal DESC, occurrences DESC, score DESC, ts DESC, session, uuid, tier LIMIT 5""")
def passages_topk(spark, sf_dir):
    found = ranked_hits(spark, sf_dir)
    ranked = ranking.sessions(found, matching.turn_counts(turns3(spark, sf_dir, CONV)))
    return ranking.passages(ranking.collapse(found), ranked, 5).select("session", "uuid", "tier", "occurrences", F.round("signal", 6).alias("signal"))


@query(RANK_SQL + """SELECT substr(ts, 1, 7) AS month, count(*)::BIGINT AS hits, count(DISTINCT session)::BIGINT AS sessions FROM h WHERE ts <> '' GROUP BY 1""")
def when_buckets(spark, sf_dir):
    return ranking.months(ranked_hits(spark, sf_dir))


@query(RANK_SQL + "SELECT min(first) AS first, max(last) AS last FROM sessions")
def when_span(spark, sf_dir):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return ranking.span(ranked_sessions(spark, sf_dir)).select(shown("first"), shown("last"))


@query(RANK_SQL + """SELECT CASE WHEN repo = '' THEN '(no repo recorded)' ELSE repo END AS repo, count(*)::BIGINT AS hits, count(DISTINCT session)::BIGINT AS sessions FROM h WHERE NOT contains(lower(repo), 'payments') GROUP BY 1""")
def elsewhere(spark, sf_dir):
    return ranking.elsewhere(ranked_hits(spark, sf_dir), filters.in_scope("payments"))


# --- context

POS_SQL = ", pos AS (SELECT session, uuid, tier, ts, (row_number() OVER (PARTITION BY session ORDER BY ts, uuid, CASE tier WHEN 'conversation' THEN 0 WHEN 'invocation' THEN 1 ELSE 2 END) - 1)::BIGINT AS pos FROM turns)"
ISLANDS_SQL = """, size AS (SELECT session, max(pos) + 1 AS size FROM pos GROUP BY session
), spread AS (SELECT DISTINCT a.session, greatest(a.pos - 2, 0) AS lo, least(a.pos + 2, size - 1) AS hi FROM anchors a JOIN size USING (session)
), marked AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY session ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 WHEN row_number() OVER (PARTITION BY session ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS fresh FROM spread
), ids AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY lo, hi ROWS UNBOUNDED PRECEDING)::BIGINT AS window_id FROM marked
), merged AS (SELECT session, window_id, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi FROM ids GROUP BY session, window_id)"""


@query(POS_SQL + " SELECT session, uuid, tier, pos FROM pos")
def show_positions(spark, sf_dir):
    return context.positions(turns3(spark, sf_dir)).select("session", "uuid", "tier", "pos")


@query(POS_SQL + ", anchors AS (SELECT DISTINCT session, pos.pos FROM pos JOIN turns USING (session, uuid, tier) WHERE turns.tier = 'conversation' AND contains(folded, 'ershe'))" + ISLANDS_SQL + " SELECT session, window_id, lo, hi FROM merged")
def show_windows_query(spark, sf_dir):
    placed = context.positions(turns3(spark, sf_dir))
    found, _ = search(spark, sf_dir, "ershe")
    return context.windows(placed, context.anchors_of_hits(placed, found), 2).select("session", "window_id", "lo", "hi")


@query(POS_SQL + ", anchors AS (SELECT session, greatest(max(pos) - 2, 0) AS pos FROM pos GROUP BY session)" + ISLANDS_SQL + " SELECT session, uuid, tier, pos.pos, pos.pos = anchors.pos AS is_match FROM pos JOIN merged USING (session) JOIN anchors USING (session) WHERE pos.pos BETWEEN lo AND hi")
def show_windows_tail(spark, sf_dir):
    placed = context.positions(turns3(spark, sf_dir))
    anchors = context.anchor_of_tail(placed, 2)
    return context.window_turns(placed, context.windows(placed, anchors, 2), anchors).select("session", "uuid", "tier", "pos", "is_match")


# --- functions


STAMPS = "CASE length(uuid) % 4 WHEN 0 THEN ts WHEN 1 THEN substr(ts, 1, 10) WHEN 2 THEN replace(ts, 'Z', '') ELSE replace(ts, 'Z', '.125+02:00') END"


@query(f"""SELECT session, uuid, tier, {STAMPS} AS ts, ts <> '' AND length(uuid) % 4 IN (0, 3) AS dated FROM turns""")
def parse_time(spark, sf_dir):
    return turns3(spark, sf_dir).withColumn("ts", F.expr(STAMPS)).select("session", "uuid", "tier", "ts", F.coalesce(X.parse_ts(F.col("ts")).isNotNull(), F.lit(False)).alias("dated"))


REMOTE = "CASE length(uuid) % 3 WHEN 0 THEN 'https://user:tok@Host.example:8443/' || repo || '.git' WHEN 1 THEN 'git@Host.example:' || repo || '.git' ELSE 'ssh://git@Host.example:22/' || repo || '/' END"


@query(f"""SELECT DISTINCT {REMOTE} AS remote, 'host.example/' || lower(ltrim(repo, '/')) AS id FROM turns WHERE repo <> ''""")
def remote_normalize(spark, sf_dir):
    remotes = turns3(spark, sf_dir).where("repo <> ''").select(F.expr(REMOTE).alias("remote")).distinct()
    return remotes.select("remote", X.remote_id(F.col("remote")).alias("id"))