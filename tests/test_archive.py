"""Transcripts with every oddity, ingested cold, in steps, and again."""

import json
import os

import pytest

from turnlake.functions import render
from turnlake.operators.archive import Archive
from turnlake.plans import errors
from turnlake.plans.engine import Engine, doctor
from turnlake.sources import decode, repos


def line(uuid, text, session="s1", kind="user", **more):
    return json.dumps({"type": kind, "uuid": uuid, "sessionId": session, "timestamp": more.pop("timestamp", "2026-01-02T10:00:00Z"), "message": {"role": kind, "content": text}, **more}) + "\n"


def write(path, *lines, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.writelines(lines)


@pytest.fixture
def root(tmp_path):
    top = str(tmp_path / "projects")
    write(f"{top}/p/s1.jsonl", line("u1", "where is marblefen", promptSource="typed", cwd="/w/a"), line("a1", [{"type": "text", "text": "it is ottergale"}, {"type": "thinking", "thinking": "", "signature": "x" * 50}, {"type": "tool_use", "name": "Run", "input": {"command": "grep kindlebrook"}}], kind="assistant"), line("r1", [{"type": "tool_result", "content": [{"type": "text", "text": "left of it " * 700 + "sorrelpike" + " right of it" * 900}]}], toolUseResult={"stdout": "never read"}), '{"type": "moon-phase", "uuid": "q"}\n', "\n", "not json\n")
    write(f"{top}/p/s2.jsonl", line("u1", "where is marblefen", promptSource="typed"), line("u2", "duskharrow here", session="s2"))
    write(f"{top}/p/s1/subagents/agent-1.jsonl", line("g1", "thistlemoor", isSidechain=True, agentId="g"))
    return top


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "archive"))


def rows(a):
    return sorted((r["session"], r["uuid"], r["tier"], r["author"], r["text"][:30]) for r in a.turns().collect())


def test_ingest_is_idempotent_and_incremental_equals_cold(spark, root, archive, tmp_path):
    first = archive.update(root, resolver=None)
    assert first.wrote and first.records_collapsed == 1 and first.turns == 6
    assert not archive.update(root, resolver=None).wrote
    write(f"{root}/p/s1.jsonl", line("u3", "amberquill"), '{"type": "user", "uuid": "half', mode="a")
    more = archive.update(root, resolver=None)
    assert more.wrote and more.turns == 1
    write(f"{root}/p/s1.jsonl", '", "sessionId": "s1", "message": {"content": "made whole"}}\n', mode="a")
    assert archive.update(root, resolver=None).turns == 1
    cold = Archive(spark, str(tmp_path / "cold"))
    cold.update(root, resolver=None)
    assert rows(cold) == rows(archive)
    assert archive.verify() == []


def test_tokens_are_where_they_were_planted(spark, root, archive):
    archive.update(root, resolver=None)
    e = Engine.over(archive)
    tiers = {"marblefen": "conversation", "ottergale": "conversation", "kindlebrook": "invocation", "sorrelpike": "result", "thistlemoor": "conversation"}
    for word, tier in tiers.items():
        found = e.find(word.upper(), tools=True, results=True)
        assert [r["tier"] for r in found.extra["hits"].collect()] == [tier], word
        alone = e.find(word)
        assert (alone.total > 0) == (tier == "conversation")
        assert tier == "conversation" or tier in alone.coverage.unsearched
    who = {r["uuid"]: r["author"] for r in archive.turns().collect()}
    assert who["u1"] == "human" and who["u2"] == "system" and who["g1"] == "agent" and who["a1"] == "assistant"


def test_show_resume_and_damage(spark, root, archive):
    archive.update(root, resolver=None)
    e = Engine.over(archive)
    assert [r["uuid"] for r in e.show("s1", "ottergale", around=0).rows.collect()] == ["a1"]
    assert e.show("s2").rows.count() == 1
    with pytest.raises(LookupError):
        e.show("s")
    assert e.resume("s1") == "cd /w/a && claude --resume s1"
    report = doctor(archive, root, resolver=None)
    assert report["unknown_types"] == {"moon-phase": 1} and report["found"] == [] and report["observed"]["malformed"] == 1
    batch = f"{archive.folder}/turns/batch={archive.pointer()['batches'][-1]}"
    victim = next(os.path.join(d, n) for d, _, names in os.walk(batch) for n in names if n.endswith(".parquet"))
    os.remove(victim)
    assert [p for _, p in archive.verify()] == ["missing"]


def test_near_misses_and_relaxation(spark, root, archive):
    archive.update(root, resolver=None)
    e = Engine.over(archive)
    near = e.find("marblefens where zebra")
    assert near.total == 1 and near.coverage.missing == ["zebra"] and near.coverage.required == 1
    typo = e.find("marblefin")
    assert typo.total == 1 and typo.coverage.substitutes == {"marblefin": ["marblefen"]}
    none = e.find("zzzzzzzz")
    assert none.total == 0 and none.coverage.reports[0]["turns"] == 0
    assert e.when("duskharrow").extra["months"].collect()[0]["month"] == "2026-01"
    assert e.turns("duskharrow").rows.collect()[0]["quote"] == "duskharrow here"
    assert "not searched: invocation, result" in e.find("duskharrow").text()


def test_force_keeps_turns_of_files_that_are_gone(spark, root, archive):
    archive.update(root, resolver=None)
    before = rows(archive)
    os.remove(f"{root}/p/s2.jsonl")
    report = doctor(archive, root, resolver=None)
    assert rows(archive) == before and len(archive.pointer()["batches"]) == 1 and report["after"] == []
    assert report["observed"]["human_shaped"] >= 1 and report["observed"]["typed"] >= 1


def test_damage_is_found_and_mended_by_force(spark, root, archive):
    archive.update(root, resolver=None)
    before = rows(archive)
    batch = f"{archive.folder}/turns/batch={archive.pointer()['batches'][-1]}"
    victim = next(os.path.join(d, n) for d, _, names in os.walk(batch) for n in names if n.endswith(".parquet"))
    os.remove(os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc"))  # else the file system finds it first
    with open(victim, "r+b") as f:
        f.seek(8)
        f.write(b"\x00" * 64)
    assert {p for _, p in archive.verify()} == {"checksum"}
    archive.update(root, resolver=None, force=True)
    assert rows(archive) == before and archive.verify() == []


def test_turns_without_an_id_are_kept_once(spark, root, archive):
    write(f"{root}/p/plain.jsonl", json.dumps({"type": "user", "sessionId": "s9", "message": {"content": "nameless"}}) + "\n")
    archive.update(root, resolver=None)
    archive.update(root, resolver=None, force=True)
    assert sum(r[4] == "nameless" for r in rows(archive)) == 1


def test_only_changed_files_are_opened(spark, root, archive):
    archive.update(root, resolver=None)
    write(f"{root}/p/[odd] {{name}}*.jsonl", line("z1", "bracketed", session="z"))
    from turnlake.sources import transcripts

    opened, was = [], transcripts.opened
    transcripts.opened = lambda spark, paths: opened.extend(paths) or was(spark, paths)
    try:
        assert archive.update(root, resolver=None).turns == 1
    finally:
        transcripts.opened = was
    assert len(opened) == 1 and "odd" in opened[0]


def test_batches_are_compacted(spark, root, archive):
    for i in range(3):
        write(f"{root}/p/more{i}.jsonl", line(f"m{i}", f"more {i}", session="m"))
        archive.update(root, resolver=None)
    before = rows(archive)
    assert not archive.compact(3) and archive.compact(2) and len(archive.pointer()["batches"]) == 1
    assert rows(archive) == before and archive.verify() == [] and not archive.update(root, resolver=None).wrote


def test_coverage_of_two_stores_and_own_answers(spark, root, archive, tmp_path):
    archive.update(root, resolver=None)
    other = Archive(spark, str(tmp_path / "other"))
    write(f"{tmp_path}/o/p/t.jsonl", line("t1", "marblefen again", session="t1", timestamp="2026-03-02T10:00:00Z"))
    other.update(f"{tmp_path}/o", resolver=None)
    e = Engine.over(archive, other)
    found = e.find("marblefen")
    said = found.text()
    assert found.total == 2 and "content 2026-01-02..2026-03-02" in said and "4 live files" in said
    write(f"{root}/p/later.jsonl", line("l1", [{"type": "tool_result", "content": said}], session="later"))
    archive.update(root, resolver=None)
    e = Engine.over(archive, other)
    assert {r["session"] for r in e.find("marblefen", results=True).rows.collect()} == {"s1", "t1"}
    assert e.find("marblefen", results=True).coverage.dropped_turns == {"own output": 1}
    assert e.find("marblefen", session="s1", self_session="s1").total == 1 and e.find("marblefen", self_session="s1").total == 1
    assert e.find("marblefen", since="2026-02-01").total == 1 and e.find("marblefen", mine=True).total == 1
    for bad in ({"since": "2026-03", "until": "2026-02"}, {"mine": True, "author": "agent"}, {"since": "soon"}, {"author": "nobody"}):
        with pytest.raises(ValueError):
            e.find("marblefen", **bad)


def test_texts_fit_a_budget(spark, root, archive):
    archive.update(root, resolver=None)
    e = Engine.over(archive)
    found = e.find("marblefen ottergale duskharrow")
    full = found.text()
    assert found.fitted(10_000) == found.text(1 << 40)
    small = found.fitted(-(-len(full.encode()) // 4) - 5)
    assert len(small) < len(full)
    with pytest.raises(render.OutputTooLarge):
        found.fitted(5)
    assert all(r.endswith("\0") for r in found.records())
    shown = e.show_text("s1", "marblefen", around=0)
    assert "marblefen" in shown and shown.startswith(render.OWN_MARK)
    with pytest.raises(render.OutputTooLarge):
        e.show_text("s1", "sorrelpike", results=True, limit_bytes=500)
    found.close()


def test_misses_say_why(spark, root, archive):
    archive.update(root, resolver=None)
    e = Engine.over(archive)
    typo = e.find("marblefxx zzzzzzzz").text()
    assert "nothing found" in typo and "zzzzzzzz: in no turn, and nothing is near it" in typo and "marblefxx: in no turn; near it: marblefen" in typo
    apart = e.find("marblefen duskharrow", all_terms=True)
    assert apart.total == 0 and errors.exit_status(apart) == errors.NOTHING and errors.exit_status(e.find("marblefen")) == errors.OK
    with pytest.raises(LookupError) as missing:
        e.show("nosuch")
    assert errors.exit_status(missing.value) == errors.ARCHIVE and errors.exit_status(render.OutputTooLarge()) == errors.TOO_LARGE


def test_agents_are_selected():
    pick = decode.select_agents
    assert pick("codex", {}).agents == ("codex",) and pick("", {"TURNLAKE_AGENT": "codex"}).agents == ("codex",)
    assert pick("", {"CODEX_THREAD_ID": "1"}).agents == ("codex",) and pick("", {}).agents == ("claude-code",)
    assert pick("", {"GEMINI_CLI": "1"}).fell_back and pick("", {"CODEX_THREAD_ID": "1"}, lambda a: a != "codex").fell_back
    assert pick("all", {}, lambda a: a == "codex").agents == ("codex",) and pick("auto", {"CODEX_SESSION_ID": "1"}).agents == ("codex",)
    with pytest.raises(ValueError):
        pick("nobody", {})


def SAID(t):  # noqa: N802
    return json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": t}]}}) + "\n"


META = json.dumps({"timestamp": "t", "type": "session_meta", "payload": {"id": "c1", "cwd": "/w", "git": {"branch": "b"}}}) + "\n"
ROLLOUT = "2026/01/01/rollout-2026-01-01T00-00-00-11111111-2222-3333-4444-555555555555.jsonl"


def test_codex_files(spark, tmp_path):
    top = str(tmp_path / "x")
    path = f"{top}/{ROLLOUT}"
    write(path, META, SAID("fernhollow"), json.dumps({"timestamp": "t", "type": "event_msg", "payload": {}}) + "\n", json.dumps({"timestamp": "t", "type": "response_item", "payload": {"type": "hologram"}}) + "\n")
    write(f"{path}.zst", "packed")
    a = Archive(spark, str(tmp_path / "a"))
    a.update(top, "codex", resolver=None)
    write(path, SAID("later"), mode="a")
    a.update(top, "codex", resolver=None)
    assert sorted((r["session"], r["branch"], r["text"]) for r in a.turns().collect()) == [("c1", "b", "fernhollow"), ("c1", "b", "later")]
    report = doctor(a, top, "codex", resolver=None)
    assert report["observed"]["telemetry"] == 1 and report["unknown_types"] == {"response_item/hologram": 1} and report["compressed_files"] == 1


def test_codex_stream_is_as_the_batch(spark, tmp_path):
    from turnlake.streaming import tail

    top, out, check = (str(tmp_path / n) for n in ("live", "out", "check"))
    for more in ([META, SAID("one")], [SAID("two"), SAID("three")], [META.replace("c1", "c2"), SAID("four")]):
        write(f"{top}/{ROLLOUT}", *more, mode="a")
        q = tail.into(tail.tail(spark, top), out, check, "codex").start()
        q.processAllAvailable()
        q.stop()
    a = Archive(spark, str(tmp_path / "a"))
    a.update(top, "codex", resolver=None)
    said = lambda df: sorted((r["session"], r["cwd"], r["branch"], r["text"]) for r in df.collect())
    assert said(spark.read.parquet(out)) == said(a.turns()) and len(said(a.turns())) == 4


def test_tail_reads_appended_lines_once(spark, tmp_path):
    from turnlake.streaming import tail

    top, out, check = (str(tmp_path / n) for n in ("live", "out", "check"))
    write(f"{top}/a.jsonl", line("u1", "one"), line("u2", "tw"))
    for more in ([], [line("u3", "three"), line("u1", "one"), '{"type": "user"']):
        write(f"{top}/a.jsonl", *more, mode="a")
        q = tail.into(tail.tail(spark, top), out, check).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["uuid"] for r in spark.read.parquet(out).collect()) == ["u1", "u2", "u3"]


def test_tail_offsets(tmp_path):
    from turnlake.streaming import tail

    path = str(tmp_path / "a.jsonl")
    write(path, "one\n", "x" * 200_000 + "\n", "half")
    reader = tail._Reader(str(tmp_path))
    first = reader.latestOffset()
    assert first[path][0] == 200_005
    (whole,) = reader.partitions({}, first)
    assert [r[1] for r in reader.read(whole)] == [0, 4]
    write(path, " line\n", mode="a")
    second = reader.latestOffset()
    assert [r[1:] for p in reader.partitions(first, second) for r in reader.read(p)] == [(200_005, 9, "half line")]
    assert reader.partitions(second, reader.latestOffset()) == []
    write(path, "new\n" + "y" * 200_001 + "\n" + "z" * 8 + "\n")  # another file of the same size
    third = reader.latestOffset()
    assert third[path][0] == second[path][0] and [p.start for p in reader.partitions(second, third)] == [0]


def test_repositories(tmp_path):
    top = tmp_path / "r"
    (top / ".git").mkdir(parents=True)
    (top / "sub").mkdir()
    (top / ".git/config").write_text('[core]\n[remote "origin"]\n  url = "git@Host:A/b.git" ; x\n')
    assert repos.resolve(str(top / "sub")) == "host/a/b"
    work = tmp_path / "wt"
    work.mkdir()
    (work / ".git").write_text(f"gitdir: {top}/.git/worktrees/gone\n")
    assert repos.resolve(str(work)) == "host/a/b"
    bare = tmp_path / "bare"
    (bare / ".git").mkdir(parents=True)
    assert repos.resolve(str(bare)) == str(bare)
    assert repos.resolve(str(tmp_path / "none")) == repos.OUTSIDE
