import datetime as dt
import gzip
import re

import pytest
from conftest import quote
from pyspark.sql import functions as F

from fixwright import rules
from fixwright.operators import quality as Q
from fixwright.operators import reproduce as R
from fixwright.operators import tape as T
from fixwright.plans import bundle, daily, verification
from fixwright.schemas import TAPE, TAPE_COLUMNS
from fixwright.sources import commits, snapshots
from fixwright.sources.tape_io import append_to_tape, open_bucketed, read_tape, read_tape_csv, write_bucketed

D = dt.date
ROWS = [
    ("H100", D(2026, 9, 1), 0, "published", 3.0, dt.datetime(2026, 9, 1, 20)),
    ("H100", D(2026, 9, 1), 1, "published", 3.1, dt.datetime(2026, 9, 3, 20)),
    ("H100", D(2026, 9, 2), 0, "published", 3.2, dt.datetime(2026, 9, 2, 20)),
    ("H100", D(2026, 9, 2), 1, "withheld", None, dt.datetime(2026, 9, 4, 20)),
    ("H100", D(2026, 9, 3), 0, "published", 4.0, dt.datetime(2026, 9, 3, 20)),
    ("A100", D(2026, 9, 3), 0, "published", 1.0, dt.datetime(2026, 9, 3, 20)),
]


@pytest.fixture(scope="module")
def tape(spark):
    return spark.createDataFrame(
        ROWS, "index_code string, index_date date, revision int, status string, value double, published_at timestamp"
    )


def test_as_of_is_what_was_known_then(tape):
    at = lambda t: {(r.index_code, r.index_date.day): r.value for r in T.as_of(tape, t).collect()}
    assert at("2026-09-02 21:00:00") == {("H100", 1): 3.0, ("H100", 2): 3.2}
    assert at("2026-09-03 20:00:00")[("H100", 1)] == 3.1
    assert at("2026-09-05 00:00:00")[("H100", 2)] is None


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_many_questions_at_once(spark, tape, limit):
    asked = spark.createDataFrame(
        [("q1", "H100", D(2026, 9, 1), dt.datetime(2026, 9, 2)), ("q2", "H100", D(2026, 9, 1), dt.datetime(2026, 9, 3, 20)),
         ("q3", "H100", D(2026, 9, 1), dt.datetime(2026, 8, 1)), ("q4", "B200", D(2026, 9, 1), dt.datetime(2026, 9, 9))],
        "question_id string, index_code string, index_date date, knowledge_time timestamp",
    )
    got = {r.question_id: r.value for r in T.as_of_each(tape, asked, limit).collect()}
    assert got == {"q1": 3.0, "q2": 3.1, "q3": None, "q4": None}


def test_revisions_are_numbered_and_superseded(spark, tape):
    new = spark.createDataFrame([("H100", D(2026, 9, 2)), ("H100", D(2026, 9, 9))], "index_code string, index_date date")
    assert sorted(r.revision for r in T.appended(tape, new).collect()) == [0, 2]
    over = {(r.index_code, r.index_date.day, r.revision): r.superseded_at for r in T.superseded(tape).collect()}
    assert over[("H100", 1, 0)] == dt.datetime(2026, 9, 3, 20) and over[("H100", 1, 1)] is None
    assert [r.revision for r in T.revisions(tape, "H100", "2026-09-02").collect()] == [0, 1]


def test_previous_published_skips_a_live_withheld_date(tape):
    rows = {r.index_date.day: r.previous for r in T.previous_published(tape).where("index_code = 'H100'").collect()}
    assert rows[1] is None
    assert rows[3].index_date == D(2026, 9, 1) and rows[3].value == 3.1
    moved = Q.level_shift(T.previous_published(tape), F.lit(0.15)).collect()
    assert [(r.index_code, r.index_date.day) for r in moved] == [("H100", 3)]


def test_a_foreign_header_is_refused(spark, tape, tmp_path):
    with pytest.raises(ValueError, match="not a prefix"):
        T.widened(tape, TAPE_COLUMNS)
    old = tmp_path / "tape.csv"
    old.write_text(",".join(TAPE_COLUMNS[:14]) + "\nH100,2026-09-01,0,published,3.0,5,9,0.1,,1.1.0,2026-09-01T20:00:00Z,,,run-1\n")
    row = read_tape_csv(spark, str(old)).first()
    assert (row.value, row.withheld_reason, row.snapshot, row.venue_holdouts) == (3.0, None, "run-1", None)


def runs(spark, rows):
    return spark.createDataFrame(rows, "run int, source string, fingerprint string")


def test_stall_needs_four_runs_and_one_set(spark):
    same = [(r, "still", f) for r in range(1, 6) for f in ("a", "b")]
    moving = [(r, "moving", f"x{r}") for r in range(1, 6)]
    grown = [(r, "grown", f) for r in range(1, 6) for f in (["a"] if r < 3 else ["a", "b"])]
    late = [(5, "new", "z")]
    gone = [(r, "gone", "a") for r in range(1, 5)]
    got = {(r.run, r.source) for r in Q.feed_stall(runs(spark, same + moving + grown + late + gone), "run").collect()}
    # a feed seen in only one of the last four runs flags too, as the rule has it
    assert got == {(4, "still"), (5, "still"), (5, "new"), (4, "gone")}


def test_dropout_compares_with_the_runs_before(spark):
    rows = [(r, "a", str(i)) for r in range(1, 5) for i in range(8 if r < 4 else 3)]
    rows += [(r, "b", str(i)) for r in range(1, 4) for i in range(6)]
    rows += [(r, "small", "x") for r in range(1, 4)]
    rows += [(r, "ok", str(i)) for r in range(1, 5) for i in range(8 if r < 4 else 4)]
    got = {(r.run, r.source): (r.rows, r.severity) for r in Q.feed_dropout(runs(spark, rows), "run").collect()}
    assert got == {(4, "a"): (3, "warn"), (4, "b"): (0, "error")}


def test_a_lone_repricing_is_told_from_a_market_move(spark):
    tape = spark.createDataFrame(
        [("H100", D(2026, 9, d), 0, "published", 3.0, "1.2.0") for d in (1, 2)] + [("A100", D(2026, 9, d), 0, "published", 3.0, "1.2.0") for d in (1, 2)],
        "index_code string, index_date date, revision int, status string, value double, methodology_version string",
    )
    move = {"H100": {"a": 0.7, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.3}, "A100": {"a": 0.7, "b": 0.89, "c": 0.88, "d": 1.0}}
    rows = [
        (code, D(2026, 9, day), "1.2.0", p, 3.0 * (k if day == 2 else 1.0), False)
        for code, panel in move.items() for p, k in panel.items() for day in (1, 2)
    ]
    votes = spark.createDataFrame(
        rows, "index_code string, index_date date, methodology_version string, provider string, price double, screened_out boolean"
    )
    got = {(r.index_code, r.provider): (r.code, r.same_way, r.peers) for r in Q.provider_level_shift(votes, tape, rules.registry()).collect()}
    assert got[("H100", "a")] == ("provider_level_shift_uncorroborated", 0, 4)
    assert got[("H100", "e")] == ("provider_level_shift_uncorroborated", 0, 4)
    assert got[("A100", "a")] == ("provider_level_shift_corroborated", 2, 3)


def market(day, shift=1.0):
    at = dt.datetime(2026, 9, day, 12)
    return [
        quote(source=f"p{i}", source_sku=f"p{i}-{k}", usd_per_hour_total=8 * (3.0 + 0.1 * i + 0.01 * k) * shift, observed_at=at, tier=1 + i % 3)
        for i in range(6) for k in range(3)
    ]


def test_publish_verify_and_tamper(spark, observations, tmp_path):
    root = str(tmp_path)
    for stamp, day, shift, at in (("r1", 1, 1.0, "2026-09-01 13:00:00"), ("r2", 2, 1.3, "2026-09-02 13:00:00"), ("r3", 2, 1.31, "2026-09-02 15:00:00")):
        obs = observations(market(day, shift)).drop("snapshot", "machine_id", "host_id")
        report = daily.run_daily(obs, root, stamp, f"2026-09-0{day}", at, revision_reason="again" if stamp == "r3" else None)
    tape = daily.records(spark, root, "tape")
    assert tape.count() == 15
    h100 = {(r.index_date.day, r.revision): r for r in tape.where("index_code = 'H100'").collect()}
    assert set(h100) == {(1, 0), (2, 0), (2, 1)} and h100[(2, 1)].status == "published"
    assert h100[(2, 1)].revision_reason == "again"
    assert {r.status for r in tape.where("index_code <> 'H100'").collect()} == {"withheld"}
    assert ("level_shift", "H100") in {(r.code, r.subject) for r in report.flags.collect()}

    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.write_snapshot(observations(market(1)), root, "r1")

    archive = snapshots.read_snapshots(spark, root)
    assert {r.snapshot: r.observations for r in snapshots.runs(archive).collect()} == {"r1": 18, "r2": 18, "r3": 18}
    verdicts = R.verify(tape, archive, rules.registry()).collect()
    assert {r.verdict for r in verdicts} == {"matched"} and len(verdicts) == 10
    tampered = tape.withColumn("value", F.when(F.col("index_date") == D(2026, 9, 1), F.col("value") + 0.01).otherwise(F.col("value")))
    bad = [r for r in R.verify(tampered, archive, rules.registry()).collect() if r.verdict != "matched"]
    assert [(r.index_code, r.verdict) for r in bad] == [("H100", "mismatch: value differs")]
    lost = R.dangling(tape, archive.where("snapshot <> 'r2'"))
    assert {r.snapshot for r in lost.collect()} == {"r2"} and lost.count() == 5

    assert daily.rebuild(spark, root, recent=1).select("snapshot").distinct().collect()[0].snapshot == "r3"
    tables = bundle.build(tape, archive, daily.rebuild(spark, root), commits.read(spark, root, "contributions", daily.VOTES))
    assert tables["latest"].where("index_code = 'H100'").first().revision == 1
    assert tables["latest_providers"].count() == 6 and tables["latest_quotes"].count() == 18
    bundle.write({k: tables[k] for k in ("summary", "coverage")}, f"{root}/bundle")
    assert spark.read.json(f"{root}/bundle/coverage").first().tape_rows == 15


def test_a_bucketed_tape_is_not_shuffled(spark, tmp_path):
    rows = spark.range(4000).selectExpr(
        "concat('i', id % 5) as index_code", "date_add(date'2026-01-01', cast(id div 20 as int)) as index_date", "cast((id div 5) % 4 as int) as revision",
        "if(id % 7 = 0, 'withheld', 'published') as status", "if(id % 7 = 0, null, id / 3.0D) as value", "timestamp_seconds(1700000000 + id) as published_at")
    tape = write_bucketed(rows, "tape_buckets", str(tmp_path / "t"), 4)
    spark.sql("DROP TABLE tape_buckets")
    tape = open_bucketed(spark, "tape_buckets", str(tmp_path / "t"), "index_code string, index_date date, revision int, status string, value double, published_at timestamp", 4)
    pairs = (
        (T.live(tape), T.live(rows)), (T.next_revision(tape), T.next_revision(rows)), (T.previous_published(tape), T.previous_published(rows)),
        (T.superseded_in_order(tape), T.superseded(rows)), (T.superseded_in_order(tape.where("revision <> 1")), T.superseded(rows.where("revision <> 1"))),
    )
    for kept, plain in pairs:
        assert sorted(map(str, kept.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    spark.sql("DROP TABLE tape_buckets")


def files_read(df):
    """Files that the scans of an executed plan have read."""
    def leaves(node):
        name = node.getClass().getSimpleName()
        kids = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        if not kids:
            children = node.children()
            kids = [children.apply(i) for i in range(children.size())]
        return [node] if not kids else [x for k in kids for x in leaves(k)]

    plan = df._jdf.queryExecution().executedPlan()
    return {x.nodeName(): x.metrics().apply("numFiles").value() for x in leaves(plan) if x.metrics().contains("numFiles")}


def test_only_wanted_runs_are_read(spark, observations, tmp_path):
    for i in range(30):
        rows = observations([quote(source=f"p{k}", observed_at=dt.datetime(2026, 9, 1 + i, 12)) for k in range(4)])
        snapshots.write_snapshot(rows.drop("snapshot", "machine_id", "host_id").coalesce(1), str(tmp_path), f"r{i:02d}")
    wanted = spark.createDataFrame([(f"r{i:02d}", "1.2.0") for i in range(3, 30, 3)] + [("gone", "1.2.0"), (None, "1.2.0")], "snapshot string, methodology_version string")
    archive = snapshots.archive(spark, str(tmp_path))
    for rows, total in ((R.wanted_runs(archive, wanted, rules.registry()), 36), (R.on_file(wanted, archive), 9)):
        assert len(rows.collect()) == total
        assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
        assert max(v for n, v in files_read(rows).items() if "text" in n) == 9


def test_verification_computes_only_what_changed(spark, observations, tmp_path, monkeypatch):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    for day in (1, 2, 3):
        obs = observations(market(day, 1 + day / 50)).drop("snapshot", "machine_id", "host_id").coalesce(1)
        daily.run_daily(obs, root, f"r{day}", f"2026-09-0{day}", f"2026-09-0{day} 13:00:00")
    tape = daily.records(spark, root, "tape")

    def verified(versions=None, whole=False):
        found = verification.verify(tape, snapshots.whole(snapshots.archive(spark, root)), store, versions)
        verdicts = {(r.index_code, r.snapshot): r.verdict for r in found.verdicts.collect()}
        if whole:
            plain = R.verify(tape, snapshots.whole(snapshots.archive(spark, root)), versions or rules.registry())
            assert verdicts == {(r.index_code, r.snapshot): r.verdict for r in plain.collect()}
        return sorted(r.snapshot for r in found.computed.collect()), verdicts

    computed, verdicts = verified()
    assert computed == ["r1", "r2", "r3"] and set(verdicts.values()) == {"matched"} and len(verdicts) == 15
    with monkeypatch.context() as m:
        m.setattr(R, "recompute", lambda *a: pytest.fail("nothing has changed"))
        assert verification.verify(tape, snapshots.whole(snapshots.archive(spark, root)), store).computed.count() == 0
    (file,) = (tmp_path / "root" / "snapshots" / "snapshot=r2").glob("*.json.gz")
    lines = gzip.open(file, "rt").read().splitlines()
    lines = [re.sub(r'"usd_per_hour_total":[0-9.]+', '"usd_per_hour_total":30.0', x) if '"p3"' in x else x for x in lines]
    with gzip.open(file, "wt") as f:
        f.write("\n".join(reversed(lines)))  # the order of lines is of no matter
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    computed, verdicts = verified(whole=True)
    assert computed == ["r2"] and verdicts["H100", "r2"] == "mismatch: value differs" and verdicts["H100", "r1"] == "matched"
    assert verified()[0] == []
    current = rules.registry()[rules.CURRENT]
    computed, _ = verified(rules.registry() | {rules.CURRENT: current.revised(rules.CURRENT, min_providers=99)})
    assert computed == ["r1", "r2", "r3"]


def test_a_bad_snapshot_line_is_kept_aside(spark, tmp_path):
    folder = tmp_path / "snapshots"
    folder.mkdir()
    (folder / "2026-09-01T120000Z.jsonl").write_text('{"source": "a", "gpu_count": 8, "payload": {"machine_id": 7}}\n{"source": broken\n')
    rows = snapshots.read_snapshots(spark, str(tmp_path)).cache()
    assert {r.snapshot for r in rows.collect()} == {"2026-09-01T120000Z"}
    assert rows.where("bad_line is not null").count() == 1 and rows.where("machine_id = 7").count() == 1
    run = snapshots.runs(rows).first()
    assert run.captured_at == dt.datetime(2026, 9, 1, 12)


def test_tape_appends_in_its_own_column_order(spark, tmp_path):
    path = str(tmp_path / "tape")
    row = spark.createDataFrame([(3.0, "H100", D(2026, 9, 1))], "value double, index_code string, index_date date")
    append_to_tape(row, path)
    append_to_tape(row, path)
    back = read_tape(spark, path)
    assert back.columns == [f.split()[0] for f in " ".join(TAPE.split()).split(", ")] and back.count() == 2


def test_one_reading_of_the_history_serves_both_checks(spark):
    """Signatures and row counts of one table give what each check reads on its own, with quotes that repeat and quotes without a fingerprint."""
    rows = [(r, "still", f) for r in range(1, 6) for f in ("a", "b", "b", None)] + [(r, "falls", str(i)) for r in range(1, 6) for i in range(8 if r < 5 else 2)]
    rows += [(r, None, "x") for r in range(1, 6)] + [(r, "gone", str(i)) for r in range(1, 5) for i in range(6)]
    feeds = Q.feed_history(runs(spark, rows), "run")
    assert feeds.where("run = 1 and source = 'still'").select("n", "rows").first() == (3, 4)
    sizes = feeds.select("run", "source", F.col("rows").alias("n"))
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(Q.stalled(feeds, "run")) == listed(Q.feed_stall(runs(spark, rows), "run")) != []
    assert listed(Q.dropped(sizes, "run")) == listed(Q.feed_dropout(runs(spark, rows), "run")) != []
