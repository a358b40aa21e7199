"""Changes between snapshots against brute force."""

import random

from palimpsest.functions.shingles import shingle_sets
from palimpsest.operators.snapshots import changes, consecutive, least_prefix, one_sided


def runs(t):
    w = t.lower().split(" ")
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def brute(rows, steps, threshold):
    by = {}
    for v, i, key, words in rows:
        by.setdefault(v, {})[i] = (key, words or "")
    out = set()
    for a, b in steps:
        old, new = by.get(a, {}), by.get(b, {})
        left_o = {i: w for i, (k, w) in old.items() if k not in {k for k, _ in new.values()}}
        left_n = {i: w for i, (k, w) in new.items() if k not in {k for k, _ in old.values()}}
        hit_o, hit_n = set(), set()
        for i, x in left_o.items():
            for j, y in left_n.items():
                s, t = runs(x), runs(y)
                if len(s & t) / len(s | t) >= threshold:
                    out.add((b, "modified", i, j))
                    hit_o.add(i)
                    hit_n.add(j)
        out |= {(b, "removed", i, 0) for i in left_o if i not in hit_o} | {(b, "added", 0, j) for j in left_n if j not in hit_n}
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows, n = [], 0
    for v in range(1, 6):
        for _ in range(60):
            n += 1
            t = " ".join(r.choices(words[: r.choice([6, 40])], k=r.choice([1, 2, 3, 8, 15])))
            rows.append((v, n, f"k{r.randint(0, 80)}" if r.random() > 0.02 else None, t if r.random() > 0.03 else None))
            if r.random() < 0.2:
                n += 1
                rows.append((v, n, rows[-1][2], rows[-1][3]))
    hot = [(v, 10_000 + v * 100 + k, "hot", "the same words again and again") for v in range(1, 6) for k in range(50)]
    rows += hot
    steps = [(1, 2), (2, 3), (3, 4), (4, 5)]
    df = spark.createDataFrame(rows + rows[:20], "version_id bigint, id bigint, key string, words string").selectExpr("*", "1 AS step", "2 AS side")
    got = [tuple(x) for x in changes(df, spark.createDataFrame(steps, "from_version bigint, to_version bigint"), 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, steps, 0.3)


def test_merge_drops_keys_of_both_sides(spark):
    rows = [(1, "a", 0), (1, "a", 1), (1, "b", 0), (1, "c", 1), (2, "a", 1), (2, "z", 0), (2, "z", 0), (2, "z", 1), (3, "q", 1)]
    got = {tuple(r) for r in one_sided(spark.createDataFrame(rows, "step bigint, key string, side int")).collect()}
    assert got == {(1, "b", 0), (1, "c", 1), (2, "a", 1), (3, "q", 1)}


def test_consecutive_leaves_out_absent_versions(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (1, 11, 3), (1, 12, 2), (1, 13, None), (None, 14, 1), (2, 20, 1)], "doc_id bigint, version_id bigint, version_no int")
    present = spark.createDataFrame([(10,), (11,), (11,), (13,), (20,)], "version_id bigint")
    assert [tuple(r) for r in consecutive(v, "doc_id", "version_id", "version_no", present).collect()] == [(10, 11)]


def test_empty(spark):
    none = spark.createDataFrame([], "version_id bigint, id bigint, key string, words string")
    assert changes(none, spark.createDataFrame([], "from_version bigint, to_version bigint"), 0.3).count() == 0


def test_prefix_and_short_sets():
    assert least_prefix(10, 0.3) == 8 and least_prefix(1, 0.3) == 1 and least_prefix(10, 1.0) == 1
    _, at = shingle_sets(["a b", "a b c", "", "a b c d", "A B C"])
    assert [int(b - a) for a, b in zip(at, at[1:], strict=False)] == [1, 1, 1, 2, 1]


def test_null_fingerprints_count_by_their_text(spark, root, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.functions.text import stored_or_fingerprint
    from palimpsest.plans import catalogue

    stored = spark.read.parquet(f"{root}/segments.parquet").withColumn("fingerprint", stored_or_fingerprint())
    roots = {"all": stored, "gaps": stored.withColumn("fingerprint", F.when(F.col("id") % 3 > 0, F.col("fingerprint")))}
    for name, df in roots.items():
        df.write.parquet(f"{tmp_path}/{name}/segments.parquet")
        for t in ("document_versions", "translations", "translation_cache"):
            (tmp_path / name / f"{t}.parquet").symlink_to(f"{root}/{t}.parquet")
    for q in ("fingerprint_dups", "cache_lookup", "fp_set_difference", "migrate_coalesce", "distinct_fingerprints", "running_heads", "diff_counts_relational", "removed_slots", "translation_plan"):
        want = sorted(map(str, catalogue.QUERIES[q](spark, f"{tmp_path}/all").collect()))
        assert sorted(map(str, catalogue.QUERIES[f"{q}_whole"](spark, f"{tmp_path}/gaps").collect())) == want, q


def test_column_changes_against_brute_force(spark):
    import random

    from palimpsest.operators.snapshots import column_changes

    r = random.Random(7)
    rows = []
    for v in (1, 2, 3):
        for k in range(60):
            if r.random() < 0.9:
                rows.append((v, f"k{k:02}", r.choice([None, 1, 2]), r.choice(["a", "b"])))
    rows += [(1, None, 5, "n"), (2, None, 6, "n"), (3, "twice", 1, "x"), (3, "twice", 1, "x"), (2, "twice", 1, "x"), (2, "hot", 1, "x"), *((3, "hot", i, "y") for i in range(50)), (None, "k00", 1, "a")]
    df = spark.createDataFrame(rows, "version_id bigint, k string, a int, b string").selectExpr("*", "1 AS step", "2 AS d")
    steps = spark.createDataFrame([(1, 2), (2, 3)], "from_version bigint, to_version bigint")
    want = set()
    for old, new in ((1, 2), (2, 3)):
        side = lambda v: {k: sorted({(str(a), b) for w, j, a, b in rows if w == v and j == k}) for k in {j for w, j, _, _ in rows if w == v}}
        o, n = side(old), side(new)
        want |= {(new, k, "removed", ()) for k in set(o) - set(n)} | {(new, k, "added", ()) for k in set(n) - set(o)}
        for k in set(o) & set(n):
            if o[k] != n[k]:
                want.add((new, k, "changed", tuple(c for i, c in enumerate("ab") if {x[i] for x in o[k]} != {x[i] for x in n[k]})))
    got = {(x.to_version, x.key, x.change_kind, tuple(x.changed)) for x in column_changes(df, steps, "k", ["a", "b"]).collect()}
    assert got == want
    assert column_changes(df.limit(0), steps, "k", ["a", "b"]).count() == 0
