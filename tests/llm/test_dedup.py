"""Exact dedup (7), SimHash (4) and line dedup (10) against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from millrace.llm import exact, lines, simhash


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_exact(cases, empty):
    for df, rows in cases:
        groups = defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        for options in ({}, {"bits_per_row": 1}, {"broadcast_bits": 0}):
            got = exact.decisions(df, **options).collect()
            assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, max(groups[t or ""]), len(groups[t or ""]), sha(t)) for i, t in rows)
            assert Counter(r.text_sha256 for r in got if r.kept) == Counter(map(sha, groups)) and all(r.doc_id == r.keep_id for r in got if r.kept)
        kept = exact.keep(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(map(max, groups.values()))
    assert exact.decisions(empty).count() == 0 and exact.keep(empty).count() == 0


def test_exact_is_native(edge):
    for df in (exact.decisions(edge), exact.keep(edge)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_repeated_bits_are_exact(spark):
    """Whatever task a text is in; a text with a third of all rows is no burden."""
    for text in ("case when id % 3 = 0 then 'hot' else concat('t', id % 2500) end", "case when id % 50 = 0 then concat('s', id % 700) else concat('t', id) end"):
        df = spark.range(0, 9000, 1, 7).selectExpr("id doc_id", f"{text} text")
        check_repeated_bits(df)


def check_repeated_bits(df):
    hashes = Counter(r.slot for r in df.select(exact._slot(1 << 20).alias("slot")).collect())
    for stretches in (1, 128):
        got = [r.bit for r in exact.repeated_bits(df, 1 << 20, stretches).collect()]
        assert len(got) == len(set(got)) and set(got) == {k for k, n in hashes.items() if n > 1}


def test_first_pass_packs_what_it_shuffles(spark):
    """Rows shuffled are some hundred a task, however many the texts are."""
    for n in (20_000, 200_000):
        df = spark.range(0, n, 1, 4).selectExpr("id doc_id", "concat('t', id) text")
        packed = exact.repeated_bits(df, 64 * n, exact.STRETCHES)
        packed.collect()
        plan = packed._jdf.queryExecution().executedPlan()
        written = [int(m.value()) for m in _metrics(plan, "shuffleRecordsWritten")]
        assert written and max(written) <= 4 * exact.STRETCHES


def _metrics(plan, name):
    """The values of a metric over the nodes of an executed plan."""
    out, left = [], [plan]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        got = node.metrics().get(name)
        if got.isDefined():
            out.append(got.get())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return out


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.decisions(df).collect())
    assert [x[:3] for x in got] == [("3", "3", 2), ("None", "3", 2), ("None", "None", 2), ("None", "None", 2)] and sum(x[3] for x in got) == 2


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    made = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_classes(rows, radius=2):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, fp[i], least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_simhash(cases, empty):
    for df, rows in cases:
        want = brute_classes(rows)
        for chunk in (simhash.CHUNK, 2):
            got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.classes(df, chunk=chunk).collect())
            assert got == want
        for ids in (simhash.BROADCAST_IDS, 0):
            kept = simhash.keep_one(df, broadcast_ids=ids)
            assert kept.columns == df.columns
            assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    assert simhash.classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_bit_sliced_comparison_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fp = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)], base ^ np.uint64(7), base ^ np.uint64(15)])
    for radius in (0, 1, 2, 3, 7):
        want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= radius}
        got = {(int(a), int(b)) for i, j in simhash.near(fp, fp, radius) for a, b in zip(i, j)}
        assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100} | {200 + i: 200 for i in range(1, 50)}


def brute_lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = Counter()
    for i, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if docs[key(x)] < least]
        out[i, len(own), len(own) - len(left), "\n".join(left)] += 1
    return out


def test_common_lines(cases, empty):
    for df, rows in cases:
        for options in ({}, {"broadcast_keys": 0}, {"batches": 3}):
            got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_common(df, **options).collect())
            assert got == brute_lines(rows)
    assert lines.drop_common(empty).count() == 0


def exchanges(df):
    """The shuffles of the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange" in x]


def test_runs_are_never_shuffled(spark):
    """Merging two runs, and a batch's anti-join with them, stay within buckets."""
    rng = np.random.default_rng(0)
    rows = lambda: spark.createDataFrame([(int(h), int(h) * 7, 1) for h in rng.choice(5000, 900, replace=False)], "hi long, lo long, docs long")
    runs = lines.LineRuns(spark, buckets=4)
    tables = [lines.bucketed(lines.together(rows(), 4), "t", 4) for _ in range(3)]
    for t in tables[:2]:
        runs.push(t)
    merged = Counter()
    for t in tables[:2]:
        merged.update({r.hi: r.docs for r in t.collect()})
    assert [level for level, _ in runs.runs] == [1] and {r.hi: r.docs for r in runs.merged().collect()} == merged
    assert not exchanges(lines.LineRuns.merge(*tables[:2])) and not exchanges(runs.without(tables[2]))
    assert {r.hi for r in runs.without(tables[2]).collect()} == {r.hi for r in tables[2].collect()} - set(merged)


def test_keys_that_agree_in_64_bits():
    table = np.array([(1, 1), (1, 3), (1, 5), (2, 0), (7, 7)])
    d = np.array([(1, 5), (1, 4), (1, 1), (2, 0), (3, 0), (7, 8), (9, 9), (1, 3)])
    assert lines.among(d, table).tolist() == [True, False, True, True, False, False, False, True]
    assert not lines.among(d, table[:0]).any()


def test_incremental_runs(spark):
    runs = lines.LineRuns(spark, buckets=3)
    seen, rows = set(), [[(1, "a\nb"), (2, "b\nc\n")], [(3, "A\nd"), (4, None)], [(5, "d\nnew"), (6, "c")], [(7, "new\nb\nz")]]
    for batch in rows:
        got = {r.doc_id: r.kept_text for r in runs.add(spark.createDataFrame(batch, "doc_id long, text string")).collect()}
        for i, t in batch:
            assert got[i] == "\n".join(x for x in (t or "").split("\n") if not x or x.lower() not in seen)
        seen |= {x.lower() for _, t in batch for x in (t or "").split("\n") if x}
    assert sorted(level for level, _ in runs.runs) == [2]
    assert runs.merged().count() == len(seen)
