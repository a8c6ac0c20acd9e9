"""Personal data, spelling variants and centroid clustering against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from quillon.llm import lloyd, pii, queries, variants


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", "y", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, kind string, n long").repartition(3)


# personal data


def base_by_regex(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def test_base_entities_by_plain_patterns():
    rng = random.Random(1)
    bits = ["a", "x.y", "@", ".", "1", "255", "256", "007", "-", " ", "+", "(", ")", "4845168114407329", "+1 (826) 555-4081", "10.0.0.1", "é", "\n", "%", "b@c.de", "١"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = sorted((k, a, b) for k, m in enumerate(pii.base_matches(text)) for a, b, ok in m if ok)
        assert got == base_by_regex(text), text


def test_base_entities_of_the_tables(spark):
    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
    rows = pii.find(d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_by_regex(texts[r["doc_id"]])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x[0] == k for x in base) for k in range(4))
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(",")) and r["n_added"] == len(list(filter(None, r["spans"].split(",")))) - len(base)


def test_contexts_and_shapes_find_unseen_entities(spark):
    rng = random.Random(2)
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
    texts = [f"words here and call me at +1 ({rng.randint(100, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} before noon {i}" for i in range(40)]
    texts += [f"please write to user{i}@mail{i % 7}.example.com or not" for i in range(40)]
    seen = len(texts)
    hidden = [f"you can call me at {number()} before noon" for _ in range(10)]
    swallowed = [f"it stood there +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} 190.137.223.204 alone" for _ in range(5)]
    written = [f"please write to user{i} at mail{i}.example.com or not" for i in range(5)]
    clean = [f"the order {rng.randint(1_000_000, 9_999_999)} was sent on {number()} to them" for _ in range(30)]
    clean += ["version 300.1.2.3 of it", "call me at noon", "meet at example.com now"]
    texts += hidden + swallowed + written + clean + [None, "", "call me at 999.999.999.999 before"]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    added = [got[i]["n_added"] for i in range(len(texts))]
    n = seen
    assert added[:n] == [0] * n
    assert added[n : n + 10] == [1] * 10 and all(got[n + i]["spans"].startswith("phone:") for i in range(10))
    n += 10
    assert added[n : n + 5] == [1] * 5 and all("ip:" in got[n + i]["spans"] and "phone:" in got[n + i]["spans"] for i in range(5))
    n += 5
    assert added[n : n + 5] == [1] * 5
    assert added[n + 5 :] == [0] * (len(texts) - n - 5)
    i = seen
    kind, a, b = got[i]["spans"].split(":")
    assert kind == "phone" and re.fullmatch(r"[0-9 ]{12}", texts[i][int(a) : int(b)])


def scores_by_hand(edges, rounds):
    """Plain Python for the pattern and instance scores; edges: (instance, pattern, kind, failed)."""
    kind, failed, score = {}, Counter(), {}
    for i, _, k, f in edges:
        if k >= 0:
            kind[i] = min(k, kind.get(i, 9))
        failed[i] |= f
    of = {}
    for i, p, *_ in edges:
        of.setdefault(p, set()).add(i)
    fixed = dict(kind)
    score = {i: 1.0 for i in kind}
    for _ in range(rounds):
        trusted = []
        for p, members in of.items():
            total = [sum(score[i] for i in members if kind.get(i) == k) for k in range(4)]
            unknown = [i for i in members if i not in kind]
            for k in range(4):
                bad = sum(1 for i in unknown if failed[i] >> k & 1)
                c = total[k] / (sum(total) + bad + pii.UNKNOWN * (len(unknown) - bad) + pii.AGAINST)
                if total[k] >= pii.SEEDS and c >= pii.PATTERN_SCORE:
                    trusted.append((p, k, c))
        kind, score = dict(fixed), {i: 1.0 for i in fixed}
        told = {}
        for p, k, c in trusted:
            for i in of[p]:
                told.setdefault(i, {}).setdefault(k, []).append(c)
        for i, ks in told.items():
            if i in fixed:
                continue
            s = [(-(1 - float(np.prod([1 - min(c, 1 - 1e-9) for c in cs]))), k) for k, cs in ks.items() if not failed[i] >> k & 1]
            if s and -min(s)[0] >= pii.INSTANCE_SCORE:
                kind[i], score[i] = min(s)[1], -min(s)[0]
    return {i: (kind[i], round(score[i], 9)) for i in kind}


def test_scores_by_hand(spark):
    rng = random.Random(3)
    edges = {}
    for i in range(400):
        k = rng.choice([-1, -1, 0, 1, 2, 3])
        f = 0 if k >= 0 else rng.choice([0, 0, 1, 4, 8])
        for p in {rng.randrange(6) * 10 + (k if k >= 0 and rng.random() < 0.97 else rng.randrange(5)) for _ in range(rng.randint(1, 3))}:
            edges[i, p] = (i, p, k, f)
    rows = list(edges.values())
    df = spark.createDataFrame(rows, "instance long, pattern long, kind int, failed int").repartition(3)
    instances, links = pii._known(df), df.select("instance", "pattern")
    for _ in range(3):
        instances = pii.score_instances(links, instances, pii.score_patterns(links, instances))
        instances = spark.createDataFrame(instances.collect(), instances.schema)
    got = {r["instance"]: (r["kind"], round(r["score"], 9)) for r in instances.where("kind is not null").collect()}
    assert got == scores_by_hand(rows, 3) and any(s < 1 for _, s in got.values())


def test_personal_data_edges(spark):
    long = "x " * 300_000 + "a@b.co " + "1" * 300_000 + " 1.2.3.4" * 20_000 + " +1" + "(" * 100_000
    d = frame(spark, [None, "", "a@b.co", "a@b.co", long], [1, None, None, 7, 7])
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"]) for r in pii.find(d).collect())
    assert got == sorted([("1", 0, 0), ("None", 0, 0), ("None", 1, 0), ("7", 1, 0), ("7", 1, 20_000)])
    assert pii.find(d.limit(0)).count() == 0


# spelling variants


def edits_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_one_edit_shares_a_band():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("abcdeéïz") for _ in range(rng.randint(6, 9)))
        i = rng.randrange(len(a))
        b = a[:i] + rng.choice(["", rng.choice("abcdeéïz"), a[i] + "q"]) + a[i + 1 :]
        m, k = variants.masks([a, b])
        flips = sum(int(x ^ y).bit_count() for x, y in zip(m, k, strict=True))
        assert flips <= 2 and (m == k).any() and (len(a) == len(b) or (m == k).sum() == 2)


@pytest.mark.parametrize("key_words", [2000, 1])
def test_near_words_by_brute_force(spark, key_words):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(500)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa"}
    df = spark.createDataFrame([(w, rng.randint(5, 500)) for w in words], "word string, n long").repartition(3)
    got = [tuple(sorted((r["a"], r["b"]))) for r in variants.near_pairs(df, key_words).collect()]
    want = {(a, b) for a in words for b in words if a < b and edits_one(a, b)}
    assert set(got) == want and len(want) > 300
    assert len(got) == len(want) or key_words == 1 and len(got) == len(set(got))


def test_variants_edges(spark):
    # counts, chains of forms and ties
    texts = ["Wordlike " * 200 + "wordlika " * 30 + "wordliza " * 6, "wordlikE\nwordlik3 wordlike×éa", None, "", "abcdef " * 4]
    d = frame(spark, texts)
    want = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = {r["word"]: r for r in variants.group(d).collect()}
    assert {w: r["n"] for w, r in got.items()} == want
    if {"wordlike", "wordlika", "wordliza"} <= set(want):
        assert (got["wordliza"]["form"], got["wordliza"]["root"], got["wordlika"]["form_n"]) == ("wordlika", "wordlike", got["wordlike"]["n"])
    assert variants.group(d.limit(0)).count() == 0
    long = "ab" * 100_000
    assert {len(r["word"]) for r in variants.group(frame(spark, [f"{long} {long}z " * 5])).collect()} == {200_000, 200_001}


# centroid clustering


def test_exact_nearest_by_brute_force():
    rng = np.random.RandomState(6)
    for n, spread in ((1, 3), (300, 2), (700, 60), (700, 4000), (200, 1 << 25)):
        centres = rng.randint(-spread, spread + 1, (12, 5))
        x = centres[rng.randint(0, 12, n)] + rng.randint(-2, 3, (n, 5)) * rng.randint(0, 2, (n, 1))
        c = np.concatenate([x[rng.randint(0, n, 9)], centres[:4], centres[:4]])
        tree = lloyd.CoverTree(x, 8)
        assert sorted(tree.order) == list(range(n))
        for v, kids in enumerate(tree.children):
            inside = tree.order[tree.begin[v] : tree.end[v]]
            assert all(np.sqrt(((x[i] - x[tree.centre[v]]).astype(float) ** 2).sum()) <= tree.radius[v] + 1e-6 for i in inside)
            assert not kids or [tree.begin[kids[0]], tree.end[kids[-1]]] == [tree.begin[v], tree.end[v]]
        again = lloyd._unpack(*lloyd._pack(tree))
        number, distance = lloyd.nearest(x, again, c, lloyd.CoverTree(c, 2))
        d = ((x[:, None, :].astype(object) - c[None]) ** 2).sum(axis=2).astype(float)
        best = np.array([min(range(len(c)), key=lambda j: (d[i, j], j)) for i in range(n)])
        assert (number == best).all() and (distance == d[np.arange(n), best]).all()


def test_clustering_edges(spark):
    rng = random.Random(7)
    v = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    same = v()
    rows = [(i, same) for i in range(30)] + [(None, v()), (5, v()), (90, v()), (91, None), (92, [1.0] * 63), (93, [*same[:63], None]), (94, [*same[:63], float("nan")]), (95, [*same[:63], float("inf")])]
    df = spark.createDataFrame([(i, e, "k", 1) for i, e in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    got = lloyd.cluster(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter([*range(30), None, 5, 90])
    assert sum(r["distance"] for r in got) == got[0]["inertia"] and len({r["cluster"] for r in got if r["vec_id"] == 3}) == 1
    assert lloyd.cluster(df.limit(0)).count() == 0
    assert lloyd.cluster(df.where("vec_id > 90")).count() == 0
    # small tiles give the same as large ones
    d = spark.read.parquet(SF + "/embeddings.parquet")
    key = lambda rs: sorted(map(tuple, rs))
    assert key(lloyd.cluster(d, tile=37).collect()) == key(lloyd.cluster(d.repartition(5)).collect())


def test_new_queries_are_registered():
    assert {"op11_pii_bootstrapping", "op12_spelling_variants", "op13_centroid_clustering"} <= set(queries.QUERIES)


def test_a_match_is_reported_where_it_begins(spark):
    from quillon.llm import decontaminate

    item = "the passage that stands in the benchmark and is long enough to be found, whole"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    changed = [item[:2] + "q" + item[3:], item[:30] + item[31:], item[:1] + "zz" + item[1:], item]
    texts = ["words before it, some of them; " + c + " and after" for c in changed]
    rows = decontaminate.find(frame(spark, texts), bench).collect()
    # two characters were put in before the window in the third text
    assert {r["doc_id"]: r["doc_start"] - r["item_start"] for r in rows} == {0: 31, 1: 31, 2: 33, 3: 31}
    assert all(r["doc_start"] >= 31 for r in rows)
    assert decontaminate.begin_of("abcdef", "xxabcxefyy") == 2 and decontaminate.begin_of("abc", "abc") == 0


# toxicity: the label model and the scorer, by enumeration and by formula


def test_label_model_posterior_by_enumeration():
    import itertools

    from quillon.llm import toxicity

    rng = np.random.RandomState(8)
    n = 6000
    y = rng.rand(n) < 0.3
    # three independent voters, a copy of the first one that errs a little, and one that mostly abstains
    say = lambda p1, p0: np.where(y, rng.rand(n) < p1, rng.rand(n) < p0).astype(int)
    a, b, c = say(0.8, 0.1), say(0.7, 0.05), say(0.6, 0.2)
    votes = np.stack([a, b, c, np.where(rng.rand(n) < 0.95, a, 1 - a), np.where(rng.rand(n) < 0.8, -1, say(0.9, 0.05))], axis=1).astype(np.int8)
    labels = np.where(rng.rand(n) < 0.3, y.astype(int), -1)
    model = toxicity.LabelModel(votes, labels)
    # the copy and its original depend on each other
    assert model.parent[3] == 0 or model.parent[0] == 3

    def joint(v, cls):
        p = model.prior if cls else 1 - model.prior
        for j, x in enumerate(v):
            if x >= 0:
                q = model.rate[j, cls, v[model.parent[j]] + 1 if model.parent[j] >= 0 else 0]
                p *= q if x else 1 - q
        return p

    every = list(itertools.product((-1, 0, 1), repeat=5))
    got = model.posterior(np.array(every, np.int8))
    for v, p in zip(every, got, strict=True):
        assert abs(p - joint(v, 1) / (joint(v, 0) + joint(v, 1))) < 1e-9
    # who speaks does not depend on the class: what the others say sums to the prior
    for who in itertools.product((False, True), repeat=5):
        said = [v for v in every if all((x >= 0) == s for x, s in zip(v, who, strict=True))]
        assert abs(sum(joint(v, 1) for v in said) - model.prior) < 1e-9 and abs(sum(joint(v, 0) for v in said) - 1 + model.prior) < 1e-9
    # the voters' rates are found, with few labels
    assert abs(model.prior - 0.3) < 0.05
    for j, (p1, p0) in enumerate([(0.8, 0.1), (0.7, 0.05), (0.6, 0.2)]):
        if model.parent[j] < 0:
            assert abs(model.rate[j, 1, 0] - p1) < 0.07 and abs(model.rate[j, 0, 0] - p0) < 0.07
    right = ((model.posterior(votes) > 0.5) == y).mean()
    assert right > 0.9


def test_toxicity_scores_by_formula(spark):
    from quillon.llm import toxicity

    d = spark.read.parquet(SF + "/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    texts = {r["id"]: r["text"] for r in d.collect()}
    scorer = toxicity.Scorer([])
    rng = np.random.RandomState(9)
    weights = rng.normal(size=4 * scorer.size + 4) / 3
    terms = [{f"={w}" for w in words.split()} for words in toxicity.LEXICON.values()]
    for r in toxicity.score(d, scorer, weights).collect():
        text = (texts[r["id"]] or "").lower()
        tokens = text.split()
        hits = np.zeros(scorer.size)
        for token in tokens:
            for w in toxicity._LETTERS.findall(token):
                for g, group in enumerate(terms):
                    hits[len(scorer.mined) + g] += sum(f in group for f in toxicity.features_of(w))
        for j, p in enumerate(toxicity._PATTERN_LIST):
            hits[len(scorer.mined) + len(terms) + j] = len(p.findall(text))
        z, n = weights[-1], len(tokens)
        for i, c in enumerate(hits):
            z += weights[4 * i] * (c >= 1) + weights[4 * i + 1] * (c >= 2) + weights[4 * i + 2] * (c >= 4) + weights[4 * i + 3] * (min(1.0, 20 * c / max(n, 20)) if c else 0)
        z += weights[-4] * min(2.0, (hits > 0).sum() / 10) + weights[-3] * min(2.0, 20 * hits.sum() / max(n, 20)) + weights[-2] * min(2.0, np.log1p(n) / 5)
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    assert len(texts) == 200


def test_word_tables_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "letters letterz lettersx palettes palette " * 5) for i in range(3)], "doc_id long, text string")
    # Spark's own threshold, however the session is set
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        words = spark.createDataFrame([("letters", 9), ("letterz", 1), ("lettersx", 1)], "word string, n long")
        for df, rows in ((variants.near_pairs(words), 2), (variants.group(docs), None)):
            plan = lambda: df._jdf.queryExecution().executedPlan().toString()  # noqa: B023, E731
            assert "SortMergeJoin" in plan() and "BroadcastHashJoin" not in plan()
            got = df.collect()
            assert rows is None or len(got) == rows
            assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
