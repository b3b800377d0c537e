from __future__ import annotations

import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import stats
from cairn.operators import analysis, trials
from cairn.plans import evaluation
from cairn.sources import trials as readers

LOG = [
    {"type": "assistant", "message": {"content": [{"type": "text", "text": " Looking. "}, {"type": "tool_use", "id": "1", "name": "mcp__index__search", "input": {"q": "x"}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}},
    {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "2", "name": "WebSearch", "input": {}}, {"type": "tool_use", "id": "3", "name": "Read", "input": {}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "3", "content": "y" * 600}]}},
    {"type": "result", "total_cost_usd": 0.1, "result": "early"},
    {"type": "result", "total_cost_usd": 0.25, "duration_ms": 1200, "num_turns": 3, "usage": {"input_tokens": 10, "cache_read_input_tokens": 5, "output_tokens": 7}, "result": "done"},
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    lines = [json.dumps(e) for e in LOG]
    (folder / "t1.ndjson").write_text("\n".join([*lines[:2], "{broken", *lines[2:]]) + "\n")
    (folder / "t2.ndjson").write_text('{"type": "user", "message": {"content": []}}\n')
    return trials.parse_events(readers.read_events(spark, f"file://{folder}"))


def test_event_metrics(events):
    e = {r["trial_id"]: r for r in trials.efficiency(events).collect()}
    assert tuple(e["t1"])[1:] == (0.25, 15, 7, 1200, 3, "done") and tuple(e["t2"])[1:] == (0.0, 0, 0, 0, 0, "")
    b = {r["trial_id"]: r for r in trials.behavior(events).collect()}
    assert (b["t1"]["index_calls"], b["t1"]["other_calls"], b["t1"]["total_calls"], b["t1"]["web_calls"], b["t1"]["index_tools"]) == (1, 2, 3, 1, ["mcp__index__search"])
    assert b["t1"]["engagement"] == pytest.approx(1 / 3) and b["t2"]["engagement"] == 0 and b["t2"]["index_tools"] == []


def test_tool_calls_and_transcript(events):
    got = {r["id"]: r for r in trials.tool_calls(events).collect()}
    assert json.loads(got["1"]["input"]) == {"q": "x"} and got["1"]["output_preview"] == "a\nb" and got["1"]["output_length"] == 3
    assert got["2"]["output_preview"] == "" and got["3"]["output_length"] == 600 and got["3"]["output_preview"] == "y" * 500 + "..."
    text = trials.transcripts(events).where("trial_id = 't1'").first()["transcript"]
    assert text == "# Conversation Transcript\n\n## Assistant\n\nLooking.\n\n**Tool call:** `mcp__index__search`\n\n**Tool call:** `WebSearch`\n\n**Tool call:** `Read`\n\n## Final Response\n\nearly\n\n## Final Response\n\ndone\n"


def test_values_of_other_forms_are_taken_as_they_are(spark):
    """Counts as 12.0 or "7", a loose element beside tool calls, an odd field beside good ones."""
    lines = [
        {"type": "assistant", "message": {"content": ["loose", 5, None, {"type": "tool_use", "id": 1, "name": "mcp__a", "input": {"q": [1]}}, {"type": "text", "text": {"odd": 1}}]}},
        {"type": "assistant", "message": {"content": "only text"}},
        {"type": "assistant", "message": "odd"},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": ["x", {"text": "y"}]}]}},
        {"type": "result", "total_cost_usd": "0.5", "duration_ms": 1.0e3, "num_turns": "7", "usage": {"input_tokens": 12.0, "cache_read_input_tokens": "3", "cache_creation_input_tokens": [1], "output_tokens": "4.0"}, "result": 9, "extra": {"deep": [1, "a"]}},
        [1],
        7,
    ]
    rows = [("t", i, json.dumps(e)) for i, e in enumerate(lines)] + [("t", 90, '{"type": "result"'), ("u", 1, '{"type": "result", "usage": 3, "num_turns": null}')]
    events = trials.parse_events(spark.createDataFrame(rows, "trial_id string, line_no long, value string"))
    got = {r["trial_id"]: tuple(r)[1:] for r in trials.efficiency(events).collect()}
    assert got == {"t": (0.5, 15, 4, 1000, 7, "9"), "u": (0.0, 0, 0, 0, 0, "")}
    calls = trials.tool_calls(events).collect()
    assert [(r["id"], r["tool"], json.loads(r["input"]), r["output_preview"]) for r in calls] == [("1", "mcp__a", {"q": [1]}, "\ny")]
    assert trials.behavior(events).where("trial_id = 't'").first()["total_calls"] == 1
    assert events.where(F.try_variant_get("event", "$.extra.deep[1]", "string") == "a").count() == 1


def test_facts_and_structure(spark, tmp_path):
    (tmp_path / "t1.rubric.yaml").write_text("task_id: t1\nrequired_facts:\n- {pattern: 'gate(way)?', description: d, weight: 3}\n- {pattern: 'absent', description: d}\nstructure_checks:\n- {type: kind, description: d, expected: Gateway}\n- {type: required_field, description: d, field: spec.a.b}\n- {type: odd, description: d}\n- {type: no_yaml_errors, description: d}\n")
    facts, checks = readers.read_rubrics(spark, str(tmp_path), ["t1", "t2"])
    answer = "GATEWAY\n```yaml\nkind: Gateway\nspec:\n  a:\n    b: 1\n---\nkind: Other\n```\n"
    df = spark.createDataFrame([(1, "t1", answer), (2, "t1", "nothing"), (3, "t2", "x"), (4, "t1", "```yaml\na: [\n```")], "trial_id int, task_id string, response string")
    assert {r["trial_id"]: r["fact_score"] for r in trials.fact_scores(df, facts, "trial_id").collect()} == {1: 0.75, 2: 0.0, 3: 1.0, 4: 0.0}
    assert {r["trial_id"]: r["structure_score"] for r in trials.structure_scores(df, checks, "trial_id").collect()} == {1: 0.75, 2: 0.25, 3: 1.0, 4: 0.0}
    zero = spark.createDataFrame([("t1", "x", 0.0)], "task_id string, pattern string, weight double")
    assert {r["fact_score"] for r in trials.fact_scores(df.where("task_id = 't1'"), zero, "trial_id").collect()} == {0.0}
    assert readers.read_reference(str(tmp_path), "") == "" == readers.read_reference(str(tmp_path), "none.md")


def test_judges(spark):
    raw = ['{"score": 4, "reasoning": "ok"}', '```json\n{"score": 2, "reasoning": "so"}\n```', '{"score": 9}', "no", None]
    score, why = trials.judge_answer(F.col("raw"))
    got = [tuple(r) for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").orderBy("i").select(score, why).collect()]
    assert got == [(4, "ok"), (2, "so"), (None, None), (None, None), (None, None)]
    calls = spark.createDataFrame([("a", 0, 5, "x"), ("a", 1, 2, "y"), ("a", 2, None, "z"), ("b", 0, 3, "w")], "trial string, call int, score int, reasoning string")
    assert {r["trial"]: (r["judge_score"], r["judge_reasoning"]) for r in trials.judge_median(calls, "trial").collect()} == {"a": (3, "y"), "b": (3, "w")}
    c = spark.range(1).select(trials.composite(F.lit(1.0), F.lit(0.5), F.lit(5)), trials.composite(F.lit(1.0), F.lit(0.5), F.lit(None).cast("int"))).first()
    assert c[0] == pytest.approx(0.85) and c[1] == pytest.approx(0.75)


def values(spark, rows):
    return spark.createDataFrame(rows, "m string, v double")


def test_descriptive(spark):
    rng = np.random.default_rng(0)
    own = rng.normal(size=31)
    got = stats.descriptive(values(spark, [("a", float(x)) for x in own] + [("b", 2.0)]), "v", "m").orderBy("m").collect()
    assert [got[0][c] for c in ("median", "p25", "p75", "mean", "std", "n")] == pytest.approx([np.median(own), np.percentile(own, 25), np.percentile(own, 75), own.mean(), own.std(ddof=1), 31])
    assert got[1]["std"] == 0.0 and got[1]["n"] == 1


def test_cliffs_delta_equals_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 40), rng.integers(2, 11, 25)
    df = spark.createDataFrame([("a", float(v), True) for v in x] + [("a", float(v), False) for v in y] + [("b", 1.0, True)], "m string, v double, x boolean")
    got = {r["m"]: r for r in stats.cliffs_delta(df, "v", F.col("x"), "m").collect()}
    want = sum(int(a > b) - int(a < b) for a in x for b in y) / (len(x) * len(y))
    assert got["a"]["delta"] == pytest.approx(want) and (got["b"]["delta"], got["b"]["effect"]) == (0.0, "negligible")
    labels = spark.createDataFrame([(d,) for d in (0.1, -0.2, 0.4, -0.9)], "d double").select(stats.cliffs_label(F.col("d"))).collect()
    assert [r[0] for r in labels] == ["negligible", "small", "medium", "large"]


def test_hodges_lehmann(spark):
    own = [0.3, -1.2, 2.5, 0.0, 4.1]
    walsh = [(a + b) / 2 for i, a in enumerate(own) for b in own[i:]]
    got = stats.hodges_lehmann(values(spark, [("a", v) for v in own]), "v", "m").first()
    assert [got[c] for c in ("median_difference", "ci_low", "ci_high")] == pytest.approx([np.median(walsh), np.percentile(walsh, 2.5), np.percentile(walsh, 97.5)])


def test_walsh_quantiles_equal_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 57, 200):
        for own in (rng.normal(size=n), rng.integers(-3, 4, n).astype(float), np.zeros(n)):
            walsh = [(a + b) / 2 for i, a in enumerate(sorted(own)) for b in sorted(own)[i:]]
            assert stats.walsh_quantiles(own, (0.5, 0.025, 0.975, 0.0, 1.0)) == pytest.approx([np.percentile(walsh, q) for q in (50, 2.5, 97.5, 0, 100)], abs=1e-12)


def test_long_logs_keep_their_order(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"logs/{name}.ndjson").write_text("\r\n".join(f'{{"type": "x{i}"}}' for i in range(3000)) + "\r\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.read_events(spark, f"file://{tmp_path}/logs").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("a", "b"):
        own = sorted((r["line_no"], r["value"]) for r in rows if r["trial_id"] == name)
        assert [v for _, v in own] == [f'{{"type": "x{i}"}}' for i in range(3000)] and len({n for n, _ in own}) == 3000


def test_evaluate_scores_once_and_writes_back(spark, tmp_path):
    run, tasks = tmp_path / "run", tmp_path / "tasks"
    (run / "t1").mkdir(parents=True)
    (run / "t2").mkdir()
    tasks.mkdir()
    (tasks / "t1.rubric.yaml").write_text("required_facts:\n- {pattern: alpha, weight: 1}\n- {pattern: beta, weight: 3}\nstructure_checks:\n- {type: contains_code_block}\njudge_criteria: fair\n")
    (tasks / "t1.md").write_text("Say alpha.")
    trial = lambda task, rep, response, **quality: json.dumps({"meta": {"task_id": task, "condition": "with", "repetition": rep}, "quality": quality, "artifacts": {"response": response}})
    (run / "t1/with-0.json").write_text(trial("t1", 0, "t1/r.md"))
    (run / "t1/with-1.json").write_text(trial("t1", 1, "t1/r.md"))
    (run / "t1/with-2.json").write_text(trial("t1", 2, "t1/r.md", fact_score=0.5))
    (run / "t1/with-3.json").write_text(trial("t1", 3, "t1/none.md"))
    (run / "t1/with-1-tools.json").write_text("[]")
    (run / "t2/with-1.json").write_text(trial("t2", 1, "t1/r.md"))
    (run / "t1/r.md").write_text("Alpha here\n```\nx\n```\n")
    asked = tmp_path / "asked"  # judges run in tasks

    def judge(response, prompt, reference, criteria):
        with open(asked, "a") as f:
            f.write(f"{prompt}|{criteria}\n")
        return [(3, "fair"), (5, "good"), (5, "fine")]

    read = lambda name: json.loads((run / name).read_text())["quality"]
    config = evaluation.RunConfig(tasks=("t1",))
    assert evaluation.evaluate(spark, str(run), str(tasks), config, judge) == {"evaluated": 1, "skipped": 4} and asked.read_text() == "Say alpha.|fair\n"
    assert read("t1/with-1.json") == {"fact_score": 0.25, "structure_score": 1.0, "judge_score": 5, "judge_reasoning": "good", "composite_quality": round(0.3 * 0.25 + 0.3 + 0.4, 4)}
    assert read("t1/with-0.json") == {} and read("t1/with-2.json") == {"fact_score": 0.5}
    assert evaluation.evaluate(spark, str(run), str(tasks), config) == {"evaluated": 0, "skipped": 5}
    assert evaluation.evaluate(spark, str(run), str(tasks), config, force=True) == {"evaluated": 2, "skipped": 3}
    assert read("t1/with-2.json")["composite_quality"] == round((0.3 * 0.25 + 0.3) / 0.6, 4) and read("t1/with-2.json")["judge_score"] is None


def test_evaluate_odd_runs(spark, tmp_path):
    run, tasks = tmp_path / "a run #1", tmp_path / "tasks"
    tasks.mkdir()
    assert evaluation.evaluate(spark, str(run), str(tasks), evaluation.RunConfig()) == {"evaluated": 0, "skipped": 0}
    (run / "t").mkdir(parents=True)
    assert evaluation.evaluate(spark, str(run), str(tasks), evaluation.RunConfig()) == {"evaluated": 0, "skipped": 0}
    (tasks / "t.rubric.yaml").write_text("")
    (tasks / "t.md").write_text("Ask.")
    (tasks / "u.rubric.yaml").write_text("judge_criteria: fair\nreference_answer: ../tasks/u-answer.txt\n")
    (tasks / "u.md").write_text("\n Ask u. \n")
    (tasks / "u-answer.txt").write_text("because")
    record = lambda task, response: json.dumps({"extra": ["é", {"z": 1.50}], "meta": {"task_id": task, "repetition": 1}, "artifacts": {"response": response}}, ensure_ascii=False)
    (run / "t/a.json").write_text(record("t", "t/empty.md"))
    (run / "t/b.json").write_text(record("u", "t/said.md"))
    (run / "t/c.json").write_text(record("u", "t/refused.md"))
    (run / "t/d.json").write_text("{no record")
    (run / "t/e.json").write_text(json.dumps({"meta": {"task_id": "t", "repetition": 1}}))
    (run / "t/deeper").mkdir()
    (run / "t/deeper/f.json").write_text(record("t", "t/said.md"))
    (run / "t/empty.md").write_text("")
    (run / "t/said.md").write_text("why")
    (run / "t/refused.md").write_text("no")
    (run / "t/picture.png").write_bytes(b"\xff\xfe\x00")

    def judge(response, prompt, reference, criteria):
        if response == "no":
            raise OSError("no answer")
        assert (response, prompt, reference, criteria) == ("why", "Ask u.", "because", "fair")
        return [(2, "thin")]

    assert evaluation.evaluate(spark, str(run), str(tasks), evaluation.RunConfig(), judge) == {"evaluated": 3, "skipped": 2}
    read = lambda name: json.loads((run / "t" / name).read_text())
    assert read("a.json") == json.loads(record("t", "t/empty.md")) | {"quality": {"fact_score": 1.0, "structure_score": 1.0, "judge_score": None, "judge_reasoning": None, "composite_quality": 1.0}}
    assert read("b.json")["quality"] == {"fact_score": 1.0, "structure_score": 1.0, "judge_score": 2, "judge_reasoning": "thin", "composite_quality": 0.7}
    assert read("c.json")["quality"]["judge_score"] is None and read("c.json")["quality"]["composite_quality"] == 1.0
    assert (run / "t/d.json").read_text() == "{no record" and "quality" not in read("e.json") and "quality" not in read("deeper/f.json")
    assert not list(run.glob("**/*.part"))


def test_many_trials_share_a_response(spark, tmp_path):
    run, tasks = tmp_path / "run", tmp_path / "tasks"
    (run / "t").mkdir(parents=True)
    tasks.mkdir()
    (tasks / "t.rubric.yaml").write_text("required_facts: [{pattern: a}]\n")
    (run / "t/r.md").write_text("a")
    for i in range(60):
        (run / f"t/{i}.json").write_text(json.dumps({"meta": {"task_id": "t", "repetition": i}, "artifacts": {"response": "t/r.md"}}))
    assert evaluation.evaluate(spark, str(run), str(tasks), evaluation.RunConfig()) == {"evaluated": 59, "skipped": 1}
    assert evaluation.evaluate(spark, str(run), str(tasks), evaluation.RunConfig()) == {"evaluated": 0, "skipped": 60}
    assert readers.read_records(spark, str(run)).where("scored").count() == 59


def test_wilcoxon(spark):
    rows = [("a", v) for v in (1.5, -0.5, 2.0, 3.0, 0.0, -1.0)] + [("z", 0.0)] + [("t", v) for v in (1.0, 1.0, -1.0, 2.0)]
    got = {r["m"]: r for r in stats.wilcoxon(values(spark, rows), "v", "m").collect()}
    assert set(got) == {"a", "t"} and got["a"]["W"] == 3.0
    # of the 32 signs of five ranks, those with a sum of 3 or less: {}, 1, 2, 3, 1+2
    assert got["a"]["p"] == pytest.approx(2 * 5 / 32)
    assert got["t"]["W"] == 2.0 and 0 < got["t"]["p"] < 1
    assert stats.wilcoxon_p(0, 0, 0) == 1.0 and stats.wilcoxon_p(5, 0, 0) == pytest.approx(2 / 32)
    assert stats.wilcoxon_p(50, 400, 0) == pytest.approx(stats.wilcoxon_p(50, 400, 1e-9), rel=0.05)  # the curve is near the exact value


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "m string, p double")
    got = {r["m"]: (r["p_corrected"], r["significant"]) for r in stats.holm(df, "p", "m").collect()}
    assert {k: round(v[0], 6) for k, v in got.items()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}
    assert [k for k, v in got.items() if v[1]] == ["a"]


def trial_rows(quality=None):
    out = []
    for i, task in enumerate(("t1", "t2")):
        for rep in range(0, 4):
            for cond in ("with", "without"):
                if (task, rep, cond) == ("t2", 3, "without"):
                    continue
                bonus = 2.0 if cond == "with" else 0.0
                out.append((task, rep, cond, len(out), 0.1 * rep + bonus, 100 * rep, 10, 50, 3, int(bonus), 5, bonus / 5, quality and bonus / 2, None, None))
    return out


TRIALS = "task_id string, repetition int, condition string, trial_order int, total_cost_usd double, input_tokens long, output_tokens long, duration_ms long, num_turns long, index_calls long, total_calls long, engagement double, composite_quality double, fact_score double, structure_score double"


def test_analysis_and_report(spark):
    df = spark.createDataFrame(trial_rows(True), TRIALS)
    config = evaluation.RunConfig(tasks=("t1", "t2"), repetitions=3)
    report = evaluation.analyze(df, config)
    cost = report["per_metric"]["total_cost_usd"]
    assert cost["treated"]["n"] == 5 and cost["median_difference"] == 2.0 and cost["cliffs_delta"] == 1.0 and cost["effect"] == "large"
    assert report["per_metric"]["output_tokens"]["wilcoxon_W"] is None and report["per_metric"]["output_tokens"]["wilcoxon_p"] == 1.0
    assert set(report["per_metric"]) == set(analysis.METRICS + analysis.QUALITY)
    assert report["summary"]["trials"] == 11 and report["summary"]["incomplete_pairs"] == 1 and report["summary"]["engaged_share"] == 1.0
    assert report["summary"]["total_cost_usd"] == round(statistics.fsum(r[4] for r in trial_rows() if r[1] > 0), 2)
    assert report["per_task"]["t1"]["mean_engagement"] == 0.4 and report["per_task"]["t1"]["quality_treated"]["median"] == 1.0 and report["per_task"]["t2"]["quality_control"] == {"median": 0.0, "iqr": [0.0, 0.0], "mean": 0.0, "std": 0.0, "n": 2}
    text = evaluation.report_markdown("run", report)
    assert "| total_cost_usd | $2.200 |" in text and json.loads(evaluation.report_json(report)) and "| input_tokens | 200 |" in text
    assert set(evaluation.analyze(spark.createDataFrame(trial_rows(), TRIALS), config)["per_metric"]) == set(analysis.METRICS)
    assert evaluation.analyze(df.where("condition = 'with'"), config) == {}
    assert [evaluation.shown(1234.5, m) for m in ("x_cost", "a_tokens", "duration_ms", "turns")] == ["$1234.500", "1,234", "1,234ms", "1234.500"]


def test_later_trial_of_a_cell_stands(spark):
    rows = trial_rows()
    rows.append((*rows[2][:3], 99, 77.0, *rows[2][5:]))
    got = analysis.paired(spark.createDataFrame(rows, TRIALS), "with", "without", ("total_cost_usd",))
    assert got.where("task_id = 't1' AND repetition = 1").first()["x"] == 77.0


def test_schedule(spark):
    config = evaluation.RunConfig(tasks=("a", "b", "c"), repetitions=4, seed=3)
    rows = evaluation.schedule(config)
    assert rows == evaluation.schedule(config) != evaluation.schedule(evaluation.RunConfig(tasks=("a", "b", "c"), repetitions=4, seed=4))
    assert [r[0] for r in rows] == list(range(30)) and all(r[4] for r in rows[:6]) and not any(r[4] for r in rows[6:])
    assert len({r[1:4] for r in rows}) == 30
    done = spark.createDataFrame([("a", "with", 1)], "task_id string, condition string, repetition int")
    assert trials.unfinished(evaluation.schedule_table(spark, config), done, "task_id", "condition", "repetition").count() == 29


def test_trial_files(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    for name in ("r1", "r1-tools", "r1-transcript"):
        (tmp_path / f"t1/{name}.json").write_text(json.dumps({"meta": {"task_id": "t1", "repetition": 1}}, indent=1))
    assert readers.read_trials(spark, f"file://{tmp_path}").count() == 1


def test_responses_are_not_dealt_out_by_task(spark):
    """Few tasks have all responses, so that one partition would hold a task's texts."""
    df = spark.createDataFrame([(i, "t", "GATE") for i in range(8)], "trial_id int, task_id string, response string")
    facts = spark.createDataFrame([("t", "gate", 1.0), ("t", "x", 3.0), ("t", None, 1.0)], "task_id string, pattern string, weight double")
    checks = spark.createDataFrame([("t", "kind", "Other", None)], "task_id string, type string, expected string, field string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for scores, want in ((trials.fact_scores(df, facts, "trial_id"), 0.2), (trials.structure_scores(df, checks, "trial_id"), 0.0)):
            plan = scores._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert {r[1] for r in scores.collect()} == {want}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_yaml_is_parsed_by_libyaml_first(monkeypatch):
    import yaml

    plain, asked = yaml.safe_load_all, []
    monkeypatch.setattr(yaml, "safe_load_all", lambda block: asked.append(block) or plain(block))
    assert trials._yaml_documents("```yaml\na: 1\n---\n- 2\n---\nb: {c: \"x\\/y\"}\n```") == ([{"a": 1}, {"b": {"c": "x/y"}}], True) and not asked
    assert trials._yaml_documents("```yml\na: 1\n---\nb: [\n```") == ([{"a": 1}], False) and len(asked) == 1
