import pytest
from pyspark.sql import functions as F

from peakloom.operators import store as store_module
from peakloom.operators.store import STAGES, Checkpoints, StageMachine, Store, digest


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri())
    s.init()
    return s


def test_projects(store):
    a = store.upsert_project("one", total_files=3)
    b = store.upsert_project("two")
    store.update_project(a, status="completed")
    assert (store.project(a)["status"], store.project(b)["status"]) == ("completed", "running")
    assert store.upsert_project("one") == a
    assert store.project(a)["status"] == "running"
    with pytest.raises(ValueError, match="columns"):
        store.update_project(a, nothing=1)
    store.delete_project(a)
    assert store.project(a) is None


def test_checkpoints_crash_and_purge(store):
    p = store.upsert_project("one")
    assert [(r.crashed, r.can_resume) for r in store.crashed().collect()] == [(True, False)]
    c1 = store.register_checkpoint(p, "1", "pick", f"{store.root}/c1", 1.0, "x", ["peaks"])
    c2 = store.register_checkpoint(p, "2", "align", f"{store.root}/c2", 2.0, "y", ["peaks"])
    assert store.crashed().first()["resume_from"] == c2
    store.invalidate(c2)
    assert store.crashed().first()["resume_from"] == c1
    store.log(p, "pick", "ERROR", "no")
    r = store.statistics().first()
    assert (r.n_checkpoints, r.n_valid, r.total_mb, r.n_errors) == (2, 1, 3.0, 1)
    assert store.purge_invalid(p) == 1
    assert store.table("checkpoints").count() == 1


def test_rows_without_project_stay(store):
    a = store.upsert_project("one")
    store.log(None, "start", "INFO", "unassigned")
    store.log(a, "pick", "INFO", "mine")
    store.purge_invalid(a)
    store.delete_project(a)
    assert [r.message for r in store.table("processing_logs").collect()] == ["unassigned"]


@pytest.mark.parametrize("crash", ["before", "between"])
def test_a_swap_cut_short_is_finished(store, monkeypatch, crash):
    a = store.upsert_project("one")
    real, done = store_module.rename, []

    def rename(spark, source, target):
        if len(done) == (0 if crash == "before" else 1):
            raise KeyboardInterrupt
        done.append(source)
        real(spark, source, target)

    monkeypatch.setattr(store_module, "rename", rename)
    with pytest.raises(KeyboardInterrupt):
        store.update_project(a, status="completed")
    monkeypatch.undo()
    assert store.project(a)["status"] == ("running" if crash == "before" else "completed")
    store.update_project(a, status="failed")
    assert store.project(a)["status"] == "failed"


def test_numbers_do_not_come_twice(store):
    a = store.upsert_project("one")
    store.delete_project(a)
    b = store.upsert_project("two")
    assert b > a
    other = Store(store.spark, store.root)
    assert other._next("projects", "project_id") > b


def test_clean_up_is_applied(store):
    a, b = store.upsert_project("one", cache_directory=f"{store.root}/cache-a"), store.upsert_project("two")
    store.spark.range(1).write.parquet(f"{store.root}/cache-a")
    store.update_project(b, processing_stage="x")
    sizes = store.spark.createDataFrame([(a, 10.0), (b, 1.0)], "project_id long, size_mb double")
    store.log(a, "x", "INFO", "m")
    assert store.clean_up(sizes, most=5, days=10.0, gb=100.0) == []
    assert store.clean_up(sizes, now="2999-01-01 00:00:00", most=5, days=10.0, gb=100.0) == [a, b]
    assert store.table("projects").count() + store.table("processing_logs").count() == 0
    assert not store_module.exists(store.spark, f"{store.root}/cache-a")


def test_save_load_versions_and_repair(spark, tmp_path):
    c = Checkpoints(spark, tmp_path.as_uri(), keep=2)
    for i in range(3):
        c.save("match", {"t": spark.range(i + 1)})
    assert c.versions("match") == [2, 3]
    assert c.load("match")["t"].count() == 3
    assert c.load("match", 2)["t"].count() == 2
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path.as_uri()}/match/v3/t")
    with pytest.raises(ValueError, match="check"):
        c.load("match")
    assert c.load("match", repair=True)["t"].count() == 2
    assert c.health() == {"match/v3": ["t"]}
    c.health(repair=True)
    assert c.versions("match") == [2]
    with pytest.raises(KeyError):
        c.load("none")


def test_stages_resume(spark, tmp_path):
    ran = []

    def step(name):
        def f(frames):
            ran.append(name)
            return {name: frames["peaks"].withColumn("v", F.lit(name))}

        return f

    m = StageMachine(Checkpoints(spark, tmp_path.as_uri()), {s: step(s) for s in STAGES})
    m.run({"peaks": spark.range(3)}, until="grouping")
    assert m.resume_point() == "grouping"
    out = m.run({"peaks": spark.range(3)})
    assert ran == list(STAGES)
    assert set(out) == {"peaks", *STAGES}
    assert set(m.restore("temporal_correction")) == {"peak_detection", "temporal_correction"}


def test_digest_ignores_order(spark):
    assert digest(spark.range(5)) == digest(spark.range(5).orderBy(F.desc("id")))
    assert digest(spark.range(5)) != digest(spark.range(6))


def test_older_forms_are_migrated_and_newer_ones_refused(spark, tmp_path):
    import json

    c = Checkpoints(spark, tmp_path.as_uri())
    old = spark.createDataFrame([(500.25, 60.0, "1,2")], ["M.H", "CE.time", "iso.mass"])
    v = c.save("peaks", {"t": old})

    def rewrite(**changes):
        m = {k: x for k, x in (c.manifest("peaks") | changes).items() if x is not None}
        spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{c.root}/peaks/v{v}/manifest")

    assert c.load("peaks")["t"].columns == old.columns
    rewrite(schema_version=None)
    assert c.load("peaks")["t"].collect() == [(500.25, 60.0, [1.0, 2.0])]
    assert c.load("peaks")["t"].columns == ["mh", "rt", "iso_mass"]
    rewrite(schema_version=store_module.SCHEMA_VERSION + 1)
    with pytest.raises(ValueError, match="version"):
        c.load("peaks")
    with pytest.raises(ValueError, match="has a step"):
        store_module.migration(0)(lambda frames, manifest: frames)


def test_variables_and_cleaning(spark, tmp_path):
    c = Checkpoints(spark, tmp_path.as_uri(), keep=5)
    m = StageMachine(c, {})
    for i in range(3):
        c.save(STAGES[0], {"peaks": spark.range(i)})
    c.save(STAGES[1], {"peaks": spark.range(1), "pairs": spark.range(2)})
    assert m.variables(STAGES[0]) == ["peaks"]
    assert m.variables(STAGES[-1]) == ["pairs", "peaks"]
    assert c.clean(1) == [f"{STAGES[0]}/v1", f"{STAGES[0]}/v2"]
    assert c.versions(STAGES[0]) == [3] and c.versions(STAGES[1]) == [1]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    import threading

    Store(spark, tmp_path.as_uri()).init()
    ids, errors = [], []

    def work(k):
        try:
            mine = Store(spark, tmp_path.as_uri())
            for i in range(3):
                ids.append(mine.upsert_project(f"p{k}-{i}"))
                mine.upsert_project("shared", total_files=k)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    rows = Store(spark, tmp_path.as_uri()).table("projects").collect()
    assert sorted(r.project_name for r in rows) == sorted([f"p{k}-{i}" for k in range(3) for i in range(3)] + ["shared"])
    assert len({r.project_id for r in rows}) == 10 and len(set(ids)) == 9


def test_compaction_keeps_rows_and_numbers(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri())
    s.COMPACT = 3
    s.init()
    for i in range(9):
        s.log(i % 2, "x", "INFO", f"m{i}")
    s._drop("processing_logs", F.col("message") == "m8")
    s.log(1, "x", "INFO", "last")
    got = {r.log_id: r.message for r in s.table("processing_logs").collect()}
    assert got == {**{i + 1: f"m{i}" for i in range(8)}, 10: "last"}
    kept = [x.name for x in (tmp_path / "processing_logs.log").iterdir() if x.name.startswith("v")]
    assert len(kept) < 10
    # a lost or stale hint hides nothing
    hint = tmp_path / "processing_logs.log" / "_hint"
    for text in (None, "1", "no number"):
        hint.unlink(missing_ok=True)
        hint.with_name("._hint.crc").unlink(missing_ok=True)
        if text:
            hint.write_text(text)
        assert s.table("processing_logs").count() == 9
    # a reader that began before a compaction still reads what it saw
    before = s.table("processing_logs")
    for i in range(3):
        s.log(1, "x", "INFO", f"n{i}")
    assert before.count() == 9 and s.table("processing_logs").count() == 12


def test_tables_from_before_there_were_commits(spark, tmp_path):
    old = [(5, "one", "", "2020-01-01 00:00:00", "2020-01-01 00:00:00", "running", 1, "x", "", "")]
    spark.createDataFrame(old, store_module.PROJECTS).write.parquet(f"{tmp_path.as_uri()}/projects")
    s = Store(spark, tmp_path.as_uri())
    assert s.table("projects").first()["project_name"] == "one"
    assert s.upsert_project("two") == 6
    assert {r.project_name for r in s.table("projects").collect()} == {"one", "two"}
