"""Memory history with snapshots (L3) against the fold of the whole history."""

from veritable.operators import ledger as L


def items(spark, *rows):
    full = [(i, "p", said, "context", status, "project", ["a"], v, None, f"2024-01-0{v or 1}") for i, said, status, v in rows]
    return spark.createDataFrame(full, L.MEMORY_SCHEMA)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def same(store):
    assert rows_of(store.current()) == rows_of(L.latest_versions(store.history()))


def test_state_is_the_fold_of_the_history(spark, tmp_path):
    store = L.MemoryStore(spark, str(tmp_path / "memory"))
    store.append(items(spark, ("a", "one", "active", 1), ("b", "two", "active", 1)))
    same(store)
    store.compact()
    same(store)
    store.append(items(spark, ("a", "one more", "active", 2)))
    store.append(items(spark, ("c", "three", "archived", 1)))
    same(store)
    store.compact()
    store.compact()  # nothing new
    store.append(items(spark, ("b", "late", "active", 1), ("a", "older", "active", 1)))  # no newer versions
    same(store)
    assert {(r.id, r.version) for r in store.current().collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert store.history().count() == 6


def test_uncommitted_rows_are_unseen(spark, tmp_path):
    store = L.MemoryStore(spark, str(tmp_path / "memory"))
    store.append(items(spark, ("a", "one", "active", 1)))
    late = store.stage(items(spark, ("a", "two", "active", 2)))
    store.compact()
    assert [r.version for r in store.current().collect()] == [1] and store.history().count() == 1
    store.commit(late)  # a slow writer: committed after the snapshot, staged before
    assert [r.version for r in store.current().collect()] == [2]


def test_only_new_folders_are_read(spark, tmp_path):
    store = L.MemoryStore(spark, str(tmp_path / "memory"))
    for v in (1, 2, 3):
        store.append(items(spark, ("a", f"v{v}", "active", v)))
    store.compact()
    assert all("/snapshots/" in f for f in store.current().inputFiles())
    store.append(items(spark, ("b", "new", "active", 1)))
    snapshot, names = store._since()
    assert snapshot and len(names) == 1
    plan = store.current()._jdf.queryExecution().optimizedPlan().toString()
    assert "(commit" in plan and names[0] in plan


def test_upsert_adds_versions_and_skips_repeats(spark, tmp_path):
    store = L.MemoryStore(spark, str(tmp_path / "memory"))
    store.append(items(spark, ("a", "one", "active", 1)))
    store.compact()
    store.upsert(items(spark, ("a", "one, edited", "active", 0), ("z", "ONE ", "active", 0), ("y", "two", "active", 0)))
    assert {(r.id, r.version, r.statement) for r in store.current().collect()} == {("a", 2, "one, edited"), ("y", 1, "two")}
    same(store)
