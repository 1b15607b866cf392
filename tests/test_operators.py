import json
import os
import subprocess

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionlake.functions import dates, porter, text
from sessionlake.operators import blame, derive, filters, lineage, maintenance, report, search, sequences, tools, topics
from sessionlake.sources.transcripts import looks_like_path


def one(spark, expression, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{k}" for k in range(len(values))]) if values else spark.range(1)
    return df.select(expression).first()[0]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electriciti", "electr"), ("adjustable", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("is", "is")])
def test_porter(word, stem):
    assert porter.stem(word) == stem


def test_frequency_words_skip_fences_paths_and_digits(spark):
    assert one(spark, text.words(F.col("c0")), "Don't /tmp/x (https://a.b/c) ab1c, Two\n```\ncode\n```\nafter a-b\n```\nlost") == ["don't", "two", "after", "a", "b"]


@pytest.mark.parametrize("given, label", [("/a/b/", "b"), ("C:\\x\\y", "y"), ("", "unknown"), ("///", "unknown")])
def test_path_labels(spark, given, label):
    assert one(spark, text.path_label(F.col("c0")), given) == label


def test_text_helpers(spark):
    assert one(spark, text.https_remote(F.col("c0")), "git@github.com:o/r.git") == "https://github.com/o/r"
    assert one(spark, text.https_remote(F.col("c0")), "ssh://git@h.org/o/r.git") == "https://h.org/o/r"
    assert one(spark, text.frontmatter_name(F.col("c0")), "---\nname: \"x y\"\nother: 1\n---\nbody") == "x y"
    assert one(spark, text.unnumbered(F.col("c0")), "  1→a\n  2→b") == "a\nb"
    assert one(spark, text.unnumbered(F.col("c0")), "  1→a\nb") == "  1→a\nb"
    assert one(spark, text.html_text(F.col("c0")), "<p>a\n b</p><br") == "a b"
    assert one(spark, text.chunks(F.col("c0"), 3), "abcdefgh") == ["abc", "def", "gh"] and one(spark, text.chunks(F.col("c0"), 3), "") == []
    assert one(spark, text.after_wrapper(F.col("c0"), F.lit("tag.image")), "<image name=x> look") == "look"
    assert one(spark, text.preview(F.col("c0"), 3), " a  bcd") == "a b..."
    assert one(spark, looks_like_path(F.col("c0")), "name") is None


def test_monday_weeks(spark):
    days = spark.sql("SELECT explode(sequence(date'2015-01-01', date'2030-12-31')) d").select("d", dates.monday_week(F.col("d")).alias("w")).collect()
    assert all(r.w == r.d.strftime("%Y-%W") for r in days)


@pytest.mark.parametrize("content, kind, repeated, relation, cls, rule", [("  <IMAGE name=a>x", "user", False, "none", "automation", "tag.image"), ("<skill a>", "user", False, "none", "interactive", "tag.skill"), ("Caveat: the messages below were", "user", False, "none", "x", "prefix.claude_caveat"), ("hi", "user", False, "subagent", "automation", "session.automation"), ("hi", "assistant", False, "subagent", "x", "relationship.subagent"), ("hi", "assistant", True, "none", "x", "message.assistant"), ("t" * 201, "user", True, "none", "x", "dup.template"), ("t" * 200, "user", True, "none", "x", "default.human")])
def test_provenance_order(spark, content, kind, repeated, relation, cls, rule):
    df = spark.createDataFrame([(content, kind, repeated, relation, cls)], "a string, b string, c boolean, d string, e string")
    assert df.select(derive.provenance(*map(F.col, "abcde"))).first()[0]["rule"] == rule


def test_json_counts_take_whole_numbers_only(spark):
    df = spark.createDataFrame([('{"k": 7}',), ('{"k": 1.5}',), ('{"k": "7"}',), ('{"k": -3}',), ("bad",), (None,), ("{}",)], "j string")
    assert [r[0] for r in df.select(derive.json_count(F.col("j"), "$.k")).collect()] == [7, 0, 0, 0, 0, 0, 0]


def test_session_classes(spark):
    schema = "session_id string, source_kind string, ordinal long, thread_source string, subagent boolean, originator string, reviewer boolean, headless boolean, sidechain boolean, kind string"
    rows = [("a", "codex", 1, "subagent", None, None, None, None, None, "user"), ("b", "codex", 1, None, None, "codex_exec", None, None, None, "user"), ("c", "codex", 1, None, None, None, None, None, None, "user"), ("d", "claude_code", 1, None, None, None, None, True, None, "user"), ("e", "claude_code", 1, None, None, None, None, None, True, "user"), ("f", "claude_code", 1, None, None, None, None, None, True, "user"), ("f", "claude_code", 2, None, None, None, None, None, False, "user"), ("g", "omp", 1, None, True, None, None, None, None, "user"), ("h", "hermes", 1, None, None, None, None, None, None, "user")]
    got = dict(map(tuple, derive.session_class(spark.createDataFrame(rows, schema)).collect()))
    assert got == {"a": "subagent", "b": "automation", "c": "interactive", "d": "automation", "e": "subagent", "f": "interactive", "g": "subagent", "h": "unknown"}


def test_roots_of_deep_chains_and_cycles(spark):
    deep = spark.range(400).select(F.concat(F.lit("s"), "id").alias("session_id"), F.when(F.col("id") > 0, F.concat(F.lit("s"), F.col("id") - 1)).alias("parent_session_id"))
    assert lineage.roots(deep).select("root_session_id").distinct().collect()[0][0] == "s0"
    with pytest.raises(ValueError):
        lineage.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "session_id string, parent_session_id string"), 6)


def test_parents_by_suffix_only_when_alone(spark):
    rows = spark.createDataFrame([("p", "m", "omp", "dir_1"), ("q", "m", "omp", "dir_2"), ("r", "m", "omp", "other_2"), ("a", "m", "omp", "x"), ("b", "m", "omp", "y"), ("c", "m2", "omp", "z")], "session_id string, machine_id string, source_kind string, external_id string")
    hints = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "session_id string, parent_external_id string")
    assert dict(map(tuple, lineage.parents(rows, hints).collect())) == {"a": "p", "b": None, "c": None}


def test_sidechains_share_their_top(spark):
    schema = "session_id string, event_id string, uuid string, parent_uuid string, sidechain boolean, task_tool_use boolean"
    rows = [("s", "e0", "u0", None, False, True), ("s", "e1", "u1", "u0", False, False), ("s", "e2", "u2", "u1", True, False), ("s", "e3", "u3", "u2", True, True), ("s", "e4", "u4", "gone", True, False), ("s", "e5", None, "u2", True, None), ("t", "f1", "u0", None, False, False), ("t", "f2", "u2", "u0", True, False)]
    overrides, relations = lineage.sidechains(spark.createDataFrame(rows, schema))
    got = dict(map(tuple, overrides.collect()))
    assert set(got) == {"e2", "e3", "e4", "e5", "f2"} and got["e2"] == got["e3"] == got["e5"] != got["e4"] and len(set(got.values())) == 3
    told = {r.session_id: (r.parent_session_id, r.relationship, r.rule) for r in relations.collect()}
    assert told == {got["e2"]: ("s", "subagent", "claude.inline_sidechain"), got["e4"]: (None, "none", "claude.inline_orphan"), got["f2"]: (None, "none", "claude.inline_orphan")}
    with pytest.raises(ValueError):
        lineage.sidechains(spark.createDataFrame([("s", "e1", "a", "b", True, False), ("s", "e2", "b", "a", True, False)], schema))


def test_effective_sessions_and_scopes(spark):
    items = spark.createDataFrame([("i1", "e1", "c", "user", "h"), ("i2", "e2", "c", "user", "x"), ("i3", "e3", "p", "user", "h"), ("i4", "e4", "c", "user", "h")], "item_id string, event_id string, session_id string, kind string, text_hash string")
    relations = spark.createDataFrame([("c", "p", "subagent"), ("z", None, "subagent"), ("d", "q", "subagent")], "session_id string, parent_session_id string, relationship string")
    scoped = lineage.scoped_inherited(items, relations, spark.createDataFrame([("p",)], "session_id string"))
    assert {tuple(r) for r in scoped.collect()} == {("i1", True), ("i2", False), ("i4", True)}
    moved = spark.createDataFrame([("e4", "z")], "event_id string, session_id string")
    got = {r.item_id: (r.effective_session_id, r.relationship) for r in lineage.effective(items, moved, relations, scoped).collect()}
    assert got == {"i1": ("c", "none"), "i2": ("c", "subagent"), "i3": ("p", "none"), "i4": ("z", "subagent")}


def test_omp_names_follow_folders(spark):
    logs = spark.createDataFrame([("/r/a/top.jsonl", None), ("/r/a/top/one.jsonl", "x"), ("/r/a/top/one/two.jsonl", None), ("/r/a/other/lone.jsonl", " /q/par.jsonl "), ("/r/b.jsonl", "bare")], "path string, parent_session string")
    got = {r.path: (r.external_id, r.parent_external_id, r.relationship) for r in lineage.omp_identity(logs).collect()}
    assert got == {"/r/a/top.jsonl": ("top", None, "none"), "/r/a/top/one.jsonl": ("top/one", "top", "subagent"), "/r/a/top/one/two.jsonl": ("top/one/two", "top/one", "subagent"), "/r/a/other/lone.jsonl": ("lone", "par", "fork"), "/r/b.jsonl": ("b", "bare", "fork")}


def test_hints_of_metadata(spark):
    name = "0a1b2c3d-0000-1111-2222-333344445555"
    rows = [("claude_code", json.dumps({"path": f"/x/{name}/subagents/agent-1.jsonl"})), ("claude_code", "{}"), ("opencode", '{"opencode_parent_id": " p "}'), ("opencode", '{"opencode_parent_id": " "}'), ("omp", '{"omp_parent_external_id": "t", "omp_relationship": "fork"}'), ("omp", "{}"), ("pi_agent", "{}"), ("codex", None)]
    got = [tuple(r.h) for r in spark.createDataFrame(rows, "k string, m string").select(lineage.hint(F.col("k"), F.col("m")).alias("h")).collect()]
    assert got == [(name, "subagent", "claude.subagent_path"), (None, "none", "default.none"), ("p", "subagent", "opencode.parent_id"), (None, "none", "default.none"), ("t", "fork", "omp.parent_session"), (None, "none", "omp.root"), (None, "none", "pi_agent.capture_gap"), (None, "none", "default.none")]


def test_forks_against_all_pairs(spark):
    import itertools
    import random

    rng, events, sessions = random.Random(5), [], []
    for s in range(40):
        base = [f"c{n}" for n in range(rng.choice([8, 9, 12]))] + [f"b{rng.randrange(3)}-{n}" for n in range(rng.choice([0, 2, 4]))]
        own = base + [f"s{s}-{n}" for n in range(rng.choice([0, 0, 3]))]
        events += [(f"s{s:02}", n, h) for n, h in enumerate(own)]
        sessions.append((f"s{s:02}", f"m{s % 2}", f"x{rng.randrange(25)}", 1_700_000_000 + rng.randrange(20), own))
    want = {}
    for c, m, x, t, own in sessions:
        met = []
        for p, pm, px, pt, other in sessions:
            common = sum(1 for _ in itertools.takewhile(lambda ab: ab[0] == ab[1], zip(own, other)))
            if pm == m and px != x and (pt, p) < (t, c) and common >= 8 and common < min(len(own), len(other)):
                met.append((common, p))
        best = [p for common, p in met if common == max(met)[0]]
        if len(best) == 1:
            want[c] = (best[0], max(met)[0])
    rows = spark.createDataFrame([s[:4] for s in sessions], "session_id string, machine_id string, external_id string, t long").withColumn("started_at", F.timestamp_seconds("t"))
    found = lineage.forks(spark.createDataFrame(events, "session_id string, ordinal long, hash string"), rows)
    assert want and {r.session_id: (r.parent_session_id, r.common) for r in found.collect()} == want


def test_affected_goes_along_long_chains(spark):
    edges = spark.range(300).select(F.concat(F.lit("s"), "id").alias("a"), F.concat(F.lit("s"), F.col("id") + 1).alias("b"))
    lone = spark.createDataFrame([("s7",), ("alone",)], "session_id string")
    assert lineage.affected(lone, edges.union(spark.createDataFrame([("x", "y")], "a string, b string"))).count() == 302


def test_notifications_collide(spark):
    sessions = spark.createDataFrame([("p", "m", "P"), ("q", "m", "Q"), ("c", "m", "C"), ("d", "m", "D")], "session_id string, machine_id string, external_id string")
    mentions = spark.createDataFrame([("p", "m", "C", 1), ("q", "m", "C", 1), ("p", "m", "D", 2)], "session_id string, machine_id string, agent_path string, ordinal long")
    assert {tuple(r) for r in lineage.notified(mentions, sessions).collect()} == {("c", "p", "notification.collision"), ("d", "p", "notification")}


CALLS = [
    ({"type": "function_call", "name": "shell", "call_id": "1", "arguments": "{}"}, ("call", "1", None)),
    ({"payload": {"type": "function_call_output", "call_id": "1", "output": "x", "metadata": {"exit_code": 1}}}, ("result", "1", "failure")),
    ({"message": {"content": [{"type": "tool_use", "id": "2", "name": "Read", "input": {"file_path": "a"}}]}}, ("call", "2", None)),
    ({"message": {"content": [{"type": "tool_result", "tool_use_id": "2", "content": [{"type": "text", "text": "y"}]}]}}, ("result", "2", "success")),
    ({"message": {"content": [{"type": "tool_result", "tool_use_id": "2", "is_error": True, "content": "y"}]}}, ("result", "2", "failure")),
    ({"tool_calls": [{"id": "3", "function": {"name": "f", "arguments": "{}"}}]}, ("call", "3", None)),
]


@pytest.mark.parametrize("event, want", CALLS)
def test_tool_shapes(event, want):
    found = tools.signals(json.dumps(event))[0]
    assert (found["signal"], found["call_id"], found["status"]) == want


def test_tool_signals_pass_over_summaries_and_repeats():
    part = {"type": "tool_use", "id": "1", "name": "a", "input": {}}
    assert len(tools.signals(json.dumps({"content": [part, part, {"type": "compaction_summary", "content": [part]}]}))) == 1
    assert tools.signals("no json") == []


@pytest.mark.parametrize("command, path", [("cat a.md", "a.md"), ("cat 'a b.md'", "a b.md"), ("cat a b", None), ("cat a | head", None), ("cat $X", None), ("less a", None), ("cat -n a", None)])
def test_cat_paths(command, path):
    assert tools.cat_path(command) == path


def test_skill_loads(spark):
    rows = [("s", "e1", "r1", "1", "Read", json.dumps({"file_path": "/w/.x/skills/tidy/SKILL.md"}), "---\nname: Tidy\n---\nb", False, "success"), ("s", "e2", "r2", "2", "shell", json.dumps({"command": "cat skills/tidy/SKILL.md"}), "b", True, "success"), ("s", "e3", "r3", "3", "Read", json.dumps({"file_path": "skill://tidy", "limit": 5}), "b", False, "success"), ("s", "e4", "r4", "4", "Read", json.dumps({"file_path": "/w/skills/tidy/SKILL.md"}), "b", False, "failure"), ("s", "e5", "r5", "5", "Read", json.dumps({"file_path": "/w/README.md"}), "b", False, "success")]
    paired = spark.createDataFrame(rows, "session_id string, event_id string, result_event_id string, call_id string, name string, arguments string, text string, truncated boolean, status string")
    got = {r.event_id: (r.skill_name, r.locator, r.coverage, r.content_hash is not None, r.load_kind) for r in tools.skill_loads(paired).collect()}
    assert got == {"e1": ("Tidy", "local:/w/.x/skills/tidy/SKILL.md", "complete", True, "reader"), "e2": ("tidy", "local:skills/tidy/SKILL.md", "partial", False, "cat"), "e3": ("tidy", "skill://tidy", "partial", False, "reader")}


def call(command, text, **args):
    return {"arguments": json.dumps({"command": command, **args}), "status": "success", "text": text, "event_id": "e", "result_event_id": "r", "call_id": "c"}


def test_commit_messages():
    header = "[main abc1234] One\n 1 file changed"
    assert tools.commits_of([call("git add . && git commit -m 'One' -m two", header)])[0]["message"] == "One\n\ntwo"
    assert tools.commits_of([call("cat <<'EOF' > /m\nfrom a file\nEOF\n", ""), call("git commit -F /m", header)])[0]["message"] == "from a file"
    assert tools.commits_of([call("printf hello > m; ls", ""), call("git commit -F m", header)])[0]["message"] is None
    assert tools.commits_of([call("printf hello > m && ls", ""), call("git commit -F m", header)])[0]["message"] == "hello"
    assert tools.commits_of([call("printf hello > m && ls", ""), call("make", ""), call("git commit -F m", header)])[0]["message"] is None
    assert tools.commits_of([call("git commit -m x", "nothing to commit")]) == []
    assert tools.commits_of([call("cd /a && cd b && git commit -m x", header)])[0]["cwd"] == "/a/b"


def test_blame_end_to_end(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"})

    git("init", "-q")
    (tmp_path / "f.txt").write_text("one\ntwo\n")
    git("add", "."), git("commit", "-qm", "Write the first lines")
    (tmp_path / "f.txt").write_text("one\ntwo\nthree\n")
    git("commit", "-qam", "Add a third line")
    (tmp_path / "f.txt").write_text("one\ntwo\nthree\nfour\n")
    lines = blame.read_git(spark, str(tmp_path), "f.txt")
    shas = {r.line: r.sha for r in lines.collect()}
    evidence = spark.createDataFrame([("s1", "e1", shas[1][:9], "x", "/w"), ("s2", "e2", "0000aaaa", "add a third line", "/w"), ("s3", "e3", "1111aaaa", "add a third line", "/no")], "session_id string, event_id string, sha string, normalized_message string, cwd string")
    commits = lines.filter("sha not rlike '^0+$'").select("sha", F.col("summary").alias("message")).distinct()
    verified = spark.createDataFrame([("/no", "rejected")], "cwd string, state string")
    marked = blame.classify(lines, blame.candidates(commits, evidence, verified))
    assert [(r.state, r.session_id) for r in marked.orderBy("line").collect()] == [("matched", "s1"), ("matched", "s1"), ("matched", "s2"), ("uncommitted", None)]
    assert [(r.session_id, r.strength, r.lines, [tuple(x) for x in r.ranges]) for r in blame.by_session(marked).collect()] == [("s1", "sha_prefix", 2, [(1, 2)]), ("s2", "message", 1, [(3, 3)])]
    assert blame.coverage(marked).first().asDict() == {"lines": 4, "matched": 3, "ambiguous": 0, "unresolved": 0, "uncommitted": 1}
    with pytest.raises(ValueError):
        blame.read_git(spark, str(tmp_path), "none.txt")


def test_fuzzy_messages(spark):
    alike = lambda a, b: one(spark, blame.alike(blame.words(F.col("c0")), blame.words(F.col("c1"))), a, b)
    assert alike("fix the parser bug", "parser bug fixed") and not alike("fix it now", "fix it not") and alike("parser", "parser") and not alike("parser of", "lexer of")


def test_hybrid_keeps_lexical_first_and_says_why_not(spark):
    items = spark.createDataFrame([(f"i{k}", "user", f"thread title summary number {k} " + "word " * 20, None) for k in range(5)] + [("z", "user", "nothing else " * 10, None)], "item_id string, kind string, text string, occurred_at timestamp")
    index = search.indexed(items)
    vectors = index.select("item_id", search.hash_embedding(F.col("text"), 16).alias("embedding"))
    found, reason = search.hybrid(index, vectors, "thread title", [1.0] + [0.0] * 15)
    assert reason is None and found.first().lexical_rank == 1
    assert search.hybrid(index, None, "thread", None)[1] == "no embedder"
    assert search.hybrid(index, vectors, "thread", [1.0])[1] == "no vectors of these dimensions"


def test_stemmed_terms_and_prefixes(spark):
    items = spark.createDataFrame([("a", "The ponies were running"), ("b", "run-time only"), ("c", "runtime")], "item_id string, text string")
    index = search.indexed(items)
    ids = lambda q: sorted(r.item_id for r in search.lexical(index, q).collect())
    assert ids("running") == ["a", "b", "c"] and ids("pony") == ["a"] and ids("run-time") == ["b"] and ids("run") == ["a", "b"] and ids("!") == []


def test_knn_filters_after_the_k(spark):
    rows = spark.createDataFrame([(k, [float(k), 0.0], k % 2) for k in range(10)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in search.nearest(rows, [0.0, 0.0], 4, keep=F.col("label") == 1).collect()] == [1, 3]
    assert [r.vec_id for r in search.nearest(rows, [0.0, 0.0], 4, keep=F.col("label") == 1, filter_first=True).collect()] == [1, 3, 5, 7]


def test_report_changes_and_summary(spark):
    now = "2024-02-01 00:00:00"
    rows = spark.sql(f"SELECT 'p' workspace, 'human' authored_by, timestamp '{now}' - make_interval(0,0,0,1,id,0,0) occurred_at FROM range(30)").union(spark.sql(f"SELECT 'p', 'human', timestamp '{now}' - make_interval(0,0,0,8,id,0,0) FROM range(20)"))
    first = report.project_changes(rows, now, (7,)).collect()
    assert [(r.current, r.previous, r.percent, r.score) for r in first] == [(30, 20, 50, 50)]
    points = spark.createDataFrame([("2024-01", "m", 10, 1500, 3600), ("2024-02", "m", 2, 1500, 7200), ("2023-12", "m", 99, 10, 1), ("2024-02", "n", 0, 100, 10)], "month string, model string, matches long, messages long, duration_secs long")
    assert [(r.model, r.matches, r.messages, round(r.per_hour, 6), round(r.delta, 6)) for r in report.frustration_summary(points).collect()] == [("m", 12, 3000, 4.0, 0.0)]
    assert [r.model for r in report.frustration_summary(points, full=True).collect()] == ["n", "m"]


def test_paging_goes_through_nulls(spark):
    rows = spark.createDataFrame([(None, "b"), (None, "a"), ("2024-01-01", "c"), ("2024-01-02", "d")], "t string, id string").withColumn("t", F.to_timestamp("t"))
    seen, at = [], None
    for _ in range(4):
        page = sequences.page(rows, ["t", "id"], 1, at).collect()
        seen.append(page[0].id)
        at = sequences.cursor(page[0].asDict(), ["t", "id"])
    assert seen == ["a", "b", "c", "d"] and len(page) == 1


def test_filters(spark):
    with pytest.raises(ValueError):
        filters.corpora(" , ")
    meta = json.dumps({"cwd": "/w/a/b", "workspace_path": "/w/a"})
    assert one(spark, filters.metadata_paths(F.col("c0")), meta) == ["/w/a", "/w/a/b"]
    assert one(spark, filters.in_scope(F.array(F.col("c0")), "/w/a"), "/w/ab") is False
    assert one(spark, filters.sha_prefixes(F.col("c0")), "ABCDEF") == ["abcd", "abcde", "abcdef"] and one(spark, filters.sha_prefixes(F.col("c0")), "ab") == []
    assert filters.prunable(spark.range(3).select(F.col("id").cast("string").alias("session_id"))).count() == 0


def test_import_conflicts(spark):
    stored = spark.createDataFrame([("a", "1")], "id string, hash string")
    rows = spark.createDataFrame([("a", "2"), ("b", "1"), ("b", "1")], "id string, hash string")
    assert maintenance.import_records(stored, rows)[1].first().asDict() == {"inserted": 1, "duplicates": 1, "conflicts": 1}
    with pytest.raises(PySparkException):
        maintenance.checked(stored, rows).collect()


def test_raw_objects(spark):
    entries = spark.createDataFrame([("m", 1, "b"), ("m", 0, "a")], "manifest_hash string, ordinal long, object_hash string")
    objects = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"\x00two"))], "hash string, content binary")
    assert bytes(maintenance.reassembled(entries, objects).first().content) == b"one\x00two"
    with pytest.raises(PySparkException):
        maintenance.reassembled(entries, objects.filter("hash = 'a'")).collect()
    artifacts = spark.createDataFrame([("h1", "/p", bytearray(b"one\n"), "2024-01-01"), ("h2", "/p", bytearray(b"one\ntwo\n"), "2024-01-02"), ("h3", "/p", bytearray(b"x"), "2024-01-01")], "hash string, path string, content binary, first_seen_at string")
    plan = maintenance.compaction(artifacts)
    assert [tuple(r) for r in plan.collect()] == [("h1", "/p", "h2")]
    events = spark.createDataFrame([("e", "h1", 0, 3), ("f", "h3", 0, 1)], "event_id string, raw_artifact_hash string, byte_offset long, byte_len long")
    assert sorted(r.raw_artifact_hash for r in maintenance.repointed(events, plan).collect()) == ["h2", "h3"]
    assert bytes(maintenance.event_bytes(events, artifacts).filter("event_id = 'e'").first().content) == b"one"
    own = artifacts.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), "content")
    accepted, rejected = maintenance.verified_blobs(maintenance.blob_rows(own).withColumn("size", F.when(F.col("size") == 1, 2).otherwise(F.col("size"))), own)
    assert accepted.count() == 2 and rejected.count() == 1


def test_annotations(spark):
    rows = spark.createDataFrame([("i", "a", "v", 3), ("i", "a", "v", 4), ("j", "a", "v", 5)], "item_id string, axis string, annotator_version string, score int")
    assert maintenance.annotated(rows.filter("item_id = 'j'"), rows).count() == 1
    with pytest.raises(PySparkException):
        maintenance.annotated(rows, rows.withColumn("score", F.lit(9))).collect()


def test_merged_json(spark):
    # the examples of RFC 7396, and sides that are no objects
    cases = [("{\"a\":\"b\"}", "{\"a\":\"c\"}"), ('{"a":"b"}', '{"b":"c"}'), ('{"a":"b"}', '{"a":null}'), ('{"a":"b","b":"c"}', '{"a":null}'), ('{"a":["b"]}', '{"a":"c"}'), ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}'), ('{"a":[{"b":"c"}]}', '{"a":[1]}'), ('["a","b"]', '["c","d"]'), ('{"e":null}', '{"a":1}'), ("[1,2]", '{"a":"b","c":null}'), ("{}", '{"a":{"bb":{"ccc":null}}}'), ('{"a":1,"b":{"c":2}}', '{"d":3}'), (None, '{"a":true}'), ('{"a":1.5}', None), ("bad", "{}")]
    df = spark.createDataFrame(cases, "d string, p string")
    got = [r[0] for r in df.select(maintenance.merged_json("d", "p")).collect()]
    assert got == ['{"a":"c"}', '{"a":"b","b":"c"}', "{}", '{"b":"c"}', '{"a":"c"}', '{"a":{"b":"d"}}', '{"a":[1]}', '["c","d"]', '{"e":null,"a":1}', '{"a":"b"}', '{"a":{"bb":{}}}', '{"a":1,"b":{"c":2},"d":3}', '{"a":true}', '{"a":1.5}', "bad"]


def test_days_of_a_zone_where_clocks_change(spark):
    df = spark.createDataFrame([("2024-03-31 12:00:00",), ("2024-10-27 00:30:00",), ("2024-06-01 22:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = [(str(r.d.start), str(r.d.end)) for r in df.select(dates.day_bounds(F.col("t"), "Europe/Berlin").alias("d")).collect()]
    assert got == [("2024-03-30 23:00:00", "2024-03-31 22:00:00"), ("2024-10-26 22:00:00", "2024-10-27 23:00:00"), ("2024-06-01 22:00:00", "2024-06-02 22:00:00")]


def test_globs(spark):
    df = spark.createDataFrame([("history_items_v3",), ("history_items",), ("a.b",), ("axb",), ("[x]",), ("A.b",)], "n string")
    found = lambda p: {r.n for r in df.filter(filters.glob(F.col("n"), p)).collect()}
    assert found("history_items_v*") == {"history_items_v3"} and found("a.b") == {"a.b"} and found("a?b") == {"a.b", "axb"} and found("[aA].b") == {"a.b", "A.b"} and found("[^a]*") == {"history_items_v3", "history_items", "[x]", "A.b"}


def test_batches_follow_memory():
    batch = search.Batch()
    assert [batch.next(m) for m in (None, 9_000, 1_000, 1_000)] == [64, 64, 32, 16]
    assert [batch.next(9_000) for _ in range(6)][-1] == 32 and batch.reductions == 2
    for _ in range(10):
        batch.next(500)
    assert batch.size == 1 and batch.next(500) == 0 and batch.next(1_000) == 1


def test_embedding_leaves_out_what_memory_has_no_room_for(spark):
    items = spark.createDataFrame([(f"i{k}", f"h{k}", "text " * 40) for k in range(200)], "item_id string, text_hash string, text string").coalesce(1)
    assert search.embed(items, lambda texts: [[1.0, 2.0]] * len(texts), "m", 2).count() == 200
    assert search.embed(items, lambda texts: [[1.0, 2.0]] * len(texts), "m", 2, memory=lambda: 100).count() == 32 + 16 + 8 + 4 + 2 + 1
    with pytest.raises(PySparkException):
        search.embed(items, lambda texts: [[1.0]] * len(texts), "m", 2).collect()


def test_an_index_is_appended_to(spark, tmp_path):
    from sessionlake.operators import postings

    rows = spark.createDataFrame([("a", "The cats sat on the mat"), ("b", "cat-like reflexes of cats"), ("c", None)], "item_id string, text string")
    index = postings.Index(spark, str(tmp_path / "i"))
    assert index.matches("cat").count() == 0 and index.append(rows) == 3 and index.append(rows) == 0
    more = spark.createDataFrame([("d", "a cat, like any"), ("a", "another text of a known item")], "item_id string, text string")
    assert postings.lacking(index, more).count() == 1 and index.append(more) == 1 and index.units().count() == 4
    whole = search.indexed(rows.union(more.filter("item_id = 'd'")).fillna(""))
    for asked, some in (("cat", False), ("cat mat", True), ("cat-like", False), ("refl", False), ("none", False), ("", False)):
        want = sorted((r.item_id, round(r.score, 9)) for r in search.matches(whole, asked, some).collect())
        assert sorted((r.item_id, round(r.score, 9)) for r in index.matches(asked, some).collect()) == want, asked


def test_profiles_name_shapes(spark):
    from sessionlake.operators import profile

    one_, two, other = (profile.profile(spark.range(1000).filter(f"id > {n}").groupBy((F.col("id") % n).alias("k")).count()) for n in (3, 7, 5))
    assert one_.kinds["aggregates"] >= 2 and one_.kinds["exchanges"] == 1 and one_.kinds["joins"] == 0
    assert profile.profile(spark.range(10), run=True).rows == 10 and other.name != profile.profile(spark.range(3)).name


def test_runs_of_enrichment_stay_as_they_are(spark):
    about = {"provider": "p", "model": "m", "destination": "d", "data_scope": "s", "max_excerpt_chars": 5, "schema_description": "x"}
    none = maintenance.enrichment_run(spark.createDataFrame([], "kind string, version string, provider string, model string, destination string, data_scope string, max_excerpt_chars long, schema_description string, created_at string"), "topics", "v1", about, "now")
    assert none.count() == 1 and maintenance.enrichment_run(none, "topics", "v1", about, "later").count() == 0
    with pytest.raises(ValueError):
        maintenance.enrichment_run(none, "topics", "v1", about | {"model": "n"}, "later")
    with pytest.raises(ValueError):
        maintenance.enrichment_run(none, " ", "v1", about, "later")


def test_imports_are_finished_in_one_order():
    seen = []
    maintenance.finalise({n: (lambda n=n: seen.append(n)) for n in ("vectors", "skills", "items")})
    assert seen == ["skills", "items", "vectors"]
    with pytest.raises(ValueError):
        maintenance.finalise({"other": print})


def test_clusters_are_taken_over(spark):
    points = spark.createDataFrame([(k, [float(k % 2) * 9 + k / 100, 1.0]) for k in range(40)], "item_id long, embedding array<double>")
    fresh = topics.cluster(points, 2, 3, 1)
    settings = (2, 3, 1, 7)
    runs = spark.createDataFrame([("v1", "completed", topics.ALGORITHM, "m", topics.input_hash(points, *settings), "2024", fresh.k, fresh.silhouette)], "version string, status string, algorithm string, model_id string, input_hash string, completed_at string, k int, silhouette double")
    held = fresh.assignments.withColumn("version", F.lit("v1"))
    again = topics.cluster(points.orderBy(F.desc("item_id")), 2, 3, 1, runs=runs, held=held, model_id="m")
    assert fresh.k == 2 and again.reused == "v1" and again.assignments.count() == 40
    assert topics.cluster(points.limit(39), 2, 3, 1, runs=runs, held=held, model_id="m").reused is None


def test_topics_need_quality(spark):
    near = spark.createDataFrame([(k, [float(k % 2) * 10 + (k % 7) * 0.01, float(k % 3) * 10]) for k in range(120)], "item_id long, embedding array<double>")
    found = topics.cluster(near, 4, 8, 2)
    assert found.k == 6 and found.silhouette > 0.9
    flat = spark.range(300).select(F.col("id").alias("item_id"), F.array(*[F.rand(k) for k in range(40)]).alias("embedding"))
    assert topics.cluster(flat, 2, 3, 1).k == 1
    with pytest.raises(ValueError):
        topics.labels([{"topic_id": 1, "texts": [], "terms": []}], lambda *_: " ")


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    from sessionlake import cluster

    plan = cluster.table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_suppkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan


def test_annotation_answers_are_checked(spark):
    from sessionlake.operators import annotate

    items = spark.createDataFrame([(f"i{k}", "text " * k) for k in range(5)], "item_id string, text string")
    ask = lambda pairs: json.dumps({i: {"clarity": 3, "trust": 5} for i, _ in pairs})
    rows = annotate.annotate(items, ask, "m", "v", ["clarity", "trust"], 2)
    assert rows.count() == 10
    left = annotate.missing(items, rows.filter("not (item_id = 'i3' and axis = 'trust')"), "v", ["clarity", "trust"])
    assert [r.item_id for r in left.collect()] == ["i3"]
    assert annotate.counters(items, rows, "v", ["clarity", "trust"]).first().asDict() == {"corpus": 5, "complete": 5, "rows_written": 10}
    for bad in ('{"i": {"a": 6}}', '{"i": {}}', '{"j": {"a": 1}}', '{"i": {"a": true}}', "[]"):
        with pytest.raises(ValueError):
            annotate.parsed(bad, ["i"], ["a"])


def test_service_answers(spark):
    from sessionlake.service import Service

    items = spark.sql("SELECT concat('i', id) item_id, 's' session_id, id ordinal, 'user' kind, concat('thread title ', id) text, 'conversation' tier, timestamp'2024-01-01' occurred_at FROM range(12)")
    sessions = spark.sql("SELECT 's' session_id, timestamp'2024-01-01' last_event_at")
    service = Service(sessions, items)
    assert json.loads(service.health())["data"]["items"] == 12 and len(json.loads(service.heads())["data"]) == 1
    found = json.loads(service.search("title", limit=3))
    assert found["ok"] and len(found["data"]["results"]) == 3 and found["data"]["semantic_unavailable"] == "no embedder"
    assert [r["ordinal"] for r in json.loads(service.show("i4", 1, 2))["data"]] == [3, 4, 5, 6]
    assert json.loads(service.show("none"))["error"]["kind"] == "LookupError" and not json.loads(service.search("x", limit=0))["ok"]
    assert "▶ user" in json.loads(service.transcript("s", "i4"))["data"] and not json.loads(service.transcript("none"))["ok"]


def test_event_segments():
    assert derive.segment('{"role": "user", "content": "a"}')[:2] == ("user", "a")
    assert derive.segment('{"message": {"role": "assistant", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "b"}]}}')[:2] == ("assistant", "b")
    assert derive.segment('{"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "no"}, {"role": "assistant", "content": "b"}]}')[:2] == ("conversation", "a\nb")
    assert derive.segment('{"role": "system", "content": "a"}')[3] == "instruction event" and derive.segment("x")[3] == "no JSON" and derive.segment('{"role": "user"}')[3] == "no conversation text"
    assert derive.segment('{"type": "exec_end"}')[3] == "tool event" and derive.segment('{"type": "note"}')[3] == "non-message event" and derive.segment('{"role": "tool"}')[3] == "tool event"
    assert derive.segment('{"type": "user", "message": {"content": " a  b "}}')[:2] == ("user", "a b")
    for leak in ('{"text": "no", "stdout": "x"}', '{"tool_use_id": 1, "text": "no"}', '{"toolUseResult": {}, "content": "no"}', '{"stderr": "", "content": [{"text": "no"}]}', '{"name": "Bash", "text": "no"}', '{"type": "compaction", "text": "no"}'):
        assert derive.segment('{"role": "user", "content": [%s, {"type": "text", "text": "yes"}]}' % leak)[1] == "yes"
    assert derive.segment('{"role": "user", "content": [{"name": "bashful", "text": "kept"}, {"type": 5, "name": "tool", "text": "too"}]}')[1] == "kept\ntoo"
    assert derive.stored_content('{"role": "user", "content": "a"}') == "a" and derive.stored_content('{"a": [1, 2.50]}') == '{"a":[1,2.5]}'
    assert json.loads(derive.stored_content('{"role": "assistant", "content": [{"type": "tool_use", "id": "1", "name": "x", "input": {}}, {"type": "text", "text": "b"}]}'))["role"] == "assistant"


def test_places_in_a_global_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    keys, total = sequences.numbered(rows, ["k"])
    assert total == 1000 and all(r.k == r._n for r in keys.collect())
    assert sorted(r.k for r in sequences.stride_sample(rows, ["k"], 3).collect()) == [0, 333, 666]


def test_hash_vectors_agree(spark):
    words = "The thing, and Ébène 42 the"
    assert one(spark, search.hash_embedding(F.col("c0"), 32), words) == pytest.approx(search.hash_vector(words, 32))
    assert one(spark, search.hash_embedding(F.col("c0"), 8), "") == search.hash_vector("", 8) == [0.0] * 8


def test_query_ideas():
    assert search.concepts("thread titles of threads") == [["conversation", "thread"], ["label", "name", "summar", "title"]]
    assert search.concepts("payment did not go through") == [["billing", "charge", "fee", "money", "payment", "stripe"], search.WRONG]
    assert search.expanded("plain words") == "plain words" and search.expanded("db crash").startswith("db crash database db crash died")
