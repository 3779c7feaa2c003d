"""The operators on small tables: against brute force, and on nulls, empty and long texts, ties and odd columns."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tierwright.llm import bpe, common, components, cotraining, decontaminate, exact_dedup, jaccard_join, language, pii, pitman_yor, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, one long text, and odd characters."""
    long_text = " ".join(f"w{i % 997} {LOREM}" for i in range(4_000))
    texts = [None, "", " \t\n", LOREM, LOREM, LOREM.upper() + ".", long_text, "é ß \x00 \x1f 😀 日本", "a", LOREM + " phi"]
    rows = [(i, x, "en" if i % 2 else None, None if i % 3 else f"s{i % 2}", None if x is None else len(x)) for i, x in enumerate(texts)]
    return [*rows, rows[3], (None, LOREM, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(odd):
    """The same rows with more columns, named as the operators' own."""
    extra = ("key", "doc", "score", "n", "text_sha256", "component", "word", "label", "bucket", "held_out", "_text", "pos", "term_id")
    return odd.select("*", *(F.lit(1).alias(c) for c in extra))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (4, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ROWS = len(odd_rows())


# every operator on odd rows, on no rows, and with clashing columns


def cases(spark, docs, labels):
    items = spark.createDataFrame([(1, LOREM), (2, None), (3, "beta"), (None, "tau upsilon")], "item_id long, text string")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://Www.A.example.org:80/x?y").alias("url"), F.col("text").alias("html"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    return {
        "cotraining": lambda: cotraining.classify(docs, labels),
        "exact": lambda: exact_dedup.deduplicate(docs),
        "pii": lambda: pii.find(docs),
        "jaccard": lambda: jaccard_join.join(docs, 3, 90),
        "warc": lambda: warc.archived_pages(pages),
        "pitman_yor": lambda: pitman_yor.score(docs),
        "toxicity": lambda: toxicity.detect(docs, labels),
        "bpe": lambda: bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")),
        "language": lambda: language.identify(docs, pages),
        "decontaminate": lambda: decontaminate.decontaminate(docs, items),
    }


NAMES = ("cotraining", "exact", "pii", "jaccard", "warc", "pitman_yor", "toxicity", "bpe", "language", "decontaminate")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, odd, clashing, labels, name):
    plain = cases(spark, odd, labels)[name]()
    rows = sorted(map(repr, plain.collect()))
    assert len(rows) == ROWS * (2 if name == "language" else 1)
    wide = cases(spark, clashing, labels)[name]()
    assert wide.columns == plain.columns
    assert len(wide.collect()) == len(rows)
    if name not in ("cotraining", "toxicity", "pitman_yor", "language"):
        assert sorted(map(repr, wide.collect())) == rows


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, none, labels, name):
    assert cases(spark, none, labels.limit(0))[name]().collect() == []


def test_pipeline_stages_keep_columns_on_odd_rows(odd, clashing, labels, spark):
    items = spark.createDataFrame([(1, "no such words at all")], "item_id long, text string")
    for stage in (lambda d: toxicity.harmless_documents(d, labels), exact_dedup.unique_documents, jaccard_join.distinct_documents, lambda d: decontaminate.clean_documents(d, items)):
        assert stage(odd).columns == odd.columns
        assert stage(clashing).columns == clashing.columns
        assert stage(odd).count() == stage(clashing).count() > 0


# 1


def test_pipeline_equals_plain_stages(spark, documents):
    import corpus_pipeline

    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), f"test-{name}")
        kept[name] = docs
    assert set(kept["toxicity"].columns) == set(documents.columns) == set(kept["decontaminate"].columns)
    texts = {r.doc_id: r.text or "" for r in kept["toxicity"].collect()}
    harmless = toxicity.detect(documents, common.table(spark, SF, "labels")).where("predicted = 0")
    assert set(texts) == {r.doc_id for r in harmless.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    texts = {i: texts[i] for i in first.values()}
    assert {r.doc_id for r in kept["exact_dedup"].collect()} == set(texts)
    near = brute_components(texts, 5, 80)
    texts = {i: x for i, x in texts.items() if near[i][1] == i}
    assert {r.doc_id for r in kept["jaccard_join"].collect()} == set(texts)

    def words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in x))

    windows = set()
    for row in common.table(spark, SF, "benchmark").collect():
        w = words(row.text or "")
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    texts = {i: x for i, x in texts.items() if not hit(words(x))}
    assert {r.doc_id for r in kept["decontaminate"].collect()} == set(texts)
    assert {r.doc_id for r in kept["bpe"].collect()} == set(texts) == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}


def test_cotraining_learns(spark, documents):
    labels = common.table(spark, SF, "labels")
    found = cotraining.classify(documents, labels).join(labels, "doc_id").toPandas()
    assert len(found) == labels.count()
    good, bad = found[found.quality == 1].score, found[found.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.9


def test_views_and_pseudo_labels_equal_plain_counts(spark):
    rng = np.random.default_rng(6)
    n, slots = 300, 40
    words = [np.unique(rng.integers(0, slots, 8)).astype("<u2") for _ in range(n)]
    bins, y, weight = rng.integers(0, cotraining.BINS, n), rng.integers(0, 2, n), rng.choice([0.5, 1.0], n)
    rows = spark.createDataFrame([(int(b), w.tobytes(), int(t), float(x), None) for b, w, t, x in zip(bins, words, y, weight)], "t_a int, words binary, y int, weight double, label int").repartition(3)
    view, odds = cotraining.View(["t_a"]), cotraining.WordView()
    view.fit(rows)
    odds.fit(rows)
    count = np.ones((2, cotraining.BINS))
    np.add.at(count, (y, bins), weight)
    p = count / count.sum(1, keepdims=True)
    assert np.allclose(view.weights[0], np.log(p[1] / p[0]))
    of_words = np.full((2, cotraining.SLOTS), 0.5)
    for w, t, x in zip(words, y, weight):
        of_words[t, w] += x
    q = of_words / of_words.sum(1, keepdims=True)
    assert np.allclose(odds.weights, np.log(q[1] / q[0]))
    score = view.prior + view.weights[0][bins]
    label = cotraining.pseudo_labels(rows, view.score(), 0.3, 0.5, view.prior - 10)
    got = rows.select("t_a", view.score().alias("s"), label.alias("l")).collect()
    low, high = np.sort(score)[[int(np.ceil(0.15 * n)) - 1, int(np.ceil(0.85 * n)) - 1]]
    assert low < high and {r.l for r in got if r.s >= high} == {1} and {r.l for r in got if r.s < high} == {None}
    few = cotraining.pseudo_labels(rows, view.score(), 0.3, 0.5, view.prior)
    assert all((r.l == 1) <= (r.s >= view.prior + cotraining.CONFIDENT) for r in rows.select(view.score().alias("s"), few.alias("l")).collect())


def test_rounds_teach_the_text_view_what_the_metadata_knows(spark):
    rng = np.random.default_rng(7)
    docs, marks = [], []
    for i in range(3_000):
        good = int(rng.integers(0, 2))
        own = [f"{'good' if good else 'bad'}{k}" for k in rng.integers(0, 1_500, 3)]
        docs.append((i, " ".join([*own, *(f"w{k}" for k in rng.integers(0, 300, 12))]), f"s{good}{rng.integers(0, 3)}"))
        if i < 300 or i % 5 == 1:
            marks.append((i, good))
    d, l = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(marks, "doc_id long, quality int")

    def right(rounds):
        found = by_id(cotraining.classify(d, l, rounds))
        out = [i for i, _ in marks if i >= 300 and found[i].held_out]
        return np.mean([(found[i].text_score > 0) == dict(marks)[i] for i in out]), np.mean([found[i].predicted == dict(marks)[i] for i in out])

    (text_before, _), (text_after, both) = right(0), right(3)
    assert text_after > text_before + 0.02 and both > 0.98


def test_calibration():
    a, b, c = cotraining.calibrated([(2.0, 0.0, 1, 90), (2.0, 0.0, 0, 10), (-2.0, 0.0, 1, 10), (-2.0, 0.0, 0, 90)])
    assert 1 / (1 + np.exp(-(2 * a + c))) == pytest.approx(0.9, abs=0.02) and b == pytest.approx(0)
    assert cotraining.calibrated([(1.0, 1.0, 1, 5)]) == (1.0, 1.0, 0.0)


# 2


def test_directory_splits_overfull_buckets_only():
    depth, slots = exact_dedup.build_directory([(0, 100, 0), (1, 100, 0), (8, 1, 0)], depth=1, capacity=150, max_depth=4)
    assert depth == 4 and slots[0] != slots[1]
    assert len(set(slots[8:])) == 1 and len(slots) == 16
    assert exact_dedup.build_directory([], depth=1, max_depth=4)[0] == 1
    assert exact_dedup.build_directory([(3, 10**9, 0)], depth=1, capacity=1, max_depth=4)[0] == 4


def test_owner_keeps_colliding_texts_apart():
    import pandas as pd

    b = pd.DataFrame([(0, 7, 5, 1, "x"), (0, 7, 3, 2, "y"), (0, 7, 4, 1, "x"), (1, 9, 1, 1, "z")], columns=["bucket", "key", "doc", "n", "text"])
    rows = [tuple(r) for f in exact_dedup.owned(iter([b.iloc[:2], b.iloc[2:]])) for r in f.itertuples(index=False)]
    assert rows == [(0, 7, 0, 4, 2, "x"), (0, 7, 1, 3, 2, "y"), (1, 9, 0, 1, 1, "z")]


def test_directory_doubles_and_rows_are_answered_through_it(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CAPACITY", 5)
    texts = {i: f"text  {i % 90}" if i % 2 else f"text {i % 90}" for i in range(300)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    rows = exact_dedup.keyed(docs)
    index, directory, depth = exact_dedup.build_index(docs, rows)
    assert depth >= 4 and directory.count() == 1 << depth and index.count() == 90
    assert 10 < index.select("bucket").distinct().count() <= directory.select("bucket").distinct().count()
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 5
    got = by_id(exact_dedup.deduplicate(docs))
    for i in texts:
        group = [j for j in texts if j % 90 == i % 90]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(group), len(group), i == min(group))
    assert sorted(r.doc_id for r in exact_dedup.unique_documents(docs).collect()) == [*range(90)]


def test_exact_dedup_is_right_on_odd_rows(odd):
    found = exact_dedup.deduplicate(odd)
    rows = by_id(found.where("doc_id IS NOT NULL"))
    assert rows[0].keep_id is None and rows[1].group_size == 3 and not rows[1].kept  # the row without an id is first
    assert rows[6].kept and rows[6].group_size == 1
    assert rows[2].text_sha256 == hashlib.sha256(b" ").hexdigest() and rows[2].kept
    assert found.where("keep_id IS NULL AND kept").count() == 2
    assert exact_dedup.unique_documents(odd).count() == found.select("text_sha256").distinct().count()


# 3


def test_base_patterns():
    text = "Mail a.b@c-d.example.org, x@y@z.com; 10.0.0.255 and 1.2.3.256 or 01.2.3.4.5; 4111 1111-1111 1111 and 4111111111111112; +1 (017) 555-7713, +12."
    kinds = collections.Counter(pii.KINDS[k] for k, *_ in pii.base_spans(text))
    assert kinds == {"email": 2, "ip": 2, "card": 1, "phone": 1}
    assert [text[a:b] for k, a, b in pii.base_spans(text) if k == 0] == ["a.b@c-d.example.org", "y@z.com"]


def test_base_patterns_equal_the_plain_ones_on_random_text():
    rng = np.random.default_rng(3)
    plain = {
        0: (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        1: (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        2: (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
        3: (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for _ in range(3_000):
        text = "".join(rng.choice(list("a1234567890.@+- ()_"), 60))
        want = [(k, m.start(), m.end()) for k, (p, ok) in plain.items() for m in re.finditer(p, text) if ok(m[0])]
        assert pii.base_spans(text) == want, text


def test_field_adds_what_patterns_miss_and_spares_plain_text():
    field = pii.train(pii.labelled_table())
    decoder = pii.Decoder(field)
    assert decoder.skip
    local, plain, year = decoder.spans(["call (017) 555-7713 now", "the and of a thing. On ea", "in 1999 the 4.50 EUR"])
    assert local == [(3, 5, 19)] and plain == [] and year == []


def test_viterbi_finds_the_best_path_and_skipping_changes_nothing():
    field = pii.train(pii.labelled_table())
    rng = np.random.default_rng(1)
    e = rng.normal(size=(4, 4, len(pii.TAGS)))
    got = pii.viterbi(e, np.array([4, 4, 4, 4]), field.moves)
    import itertools

    for r in range(4):
        score = lambda path, r=r: pii.START[path[0]] + sum(e[r, i, y] for i, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))
        assert score(tuple(got[r])) == pytest.approx(max(score(p) for p in itertools.product(range(len(pii.TAGS)), repeat=4)))
    quick, slow = pii.Decoder(field), pii.Decoder(field)
    slow.skip = False
    texts = ["The and off. wh*** then!\nTIT | ear, of", "call 555-0199 the\nof an. Ore"]
    assert quick.spans(texts) == slow.spans(texts)


def test_a_long_line_is_decoded_in_blocks_as_a_whole(monkeypatch):
    field = pii.train(pii.labelled_table())
    rng = np.random.default_rng(3)
    words = ["the", "call", "555-0199", "+1", "anna@mail", "of", "4111", "1111", "card", "10.0.0.1", "Name,"]
    line = " ".join(rng.choice(words, 500))
    whole = pii.Decoder(field).spans([line])
    for cells in (1, 7, 64):
        monkeypatch.setattr(pii, "CELLS", cells)
        assert pii.Decoder(field).spans([line]) == whole and whole[0]


def test_found_spans_that_overlap_base_spans_are_left_out():
    rng = np.random.default_rng(4)
    for _ in range(200):
        spans = lambda n: [(0, int(a), int(a) + int(rng.integers(1, 6))) for a in rng.integers(0, 60, n)]
        found, base = spans(8), spans(8)
        assert pii.apart_from(found, base) == [s for s in found if not any(s[1] < y and x < s[2] for _, x, y in base)]


def test_pii_query_equals_plain_patterns_on_documents(documents):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, x):
        digits = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    got, texts = by_id(pii.find(documents)), {r.doc_id: r.text or "" for r in documents.collect()}
    assert got.keys() == texts.keys()
    for i, x in texts.items():
        base = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, x) if right(k, m[0])]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [got[i][f"n_{k}"] for k in plain] == [sum(b[0] == k for b in base) for k in plain]
        assert got[i].base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert {*written} <= {*got[i].spans.split(",")}


# 4


def brute_components(texts, words, percent):
    sets = {}
    for i, x in texts.items():
        w = common.words_of(x or "")
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    parent[root(b)] = root(a)
    members = collections.defaultdict(list)
    for i in ids:
        members[root(i)].append(i)
    return {i: (len(sets[i]), min(m)) for m in members.values() for i in m}


def near_copies(seed, groups, size, edits):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    out, i = {}, 0
    for _ in range(groups):
        base = rng.choice(vocabulary, int(rng.integers(3, 120))).tolist()
        for _ in range(size):
            w = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                k = int(rng.integers(0, len(w)))
                w[k : k + 1] = [[], ["new" + str(rng.integers(10**6))], [w[k], w[k]]][int(rng.integers(0, 3))]
            out[i] = " ".join(w)
            i += 1
    return out


@pytest.mark.parametrize("words, percent, seed, groups, size", [(3, 90, 1, 12, 12), (5, 80, 2, 12, 12), (3, 90, 3, 2, 90), (2, 50, 4, 8, 15)])
def test_jaccard_components_equal_brute_force(spark, words, percent, seed, groups, size):
    texts = near_copies(seed, groups, size, 6)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    want = brute_components(texts, words, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard_join.join(docs, words, percent)).items()} == want


def test_jaccard_on_documents_equals_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard_join.join(documents, 3, 90)).items()} == brute_components(texts, 3, 90)


@pytest.mark.parametrize("few, salted", [(0, 7), (32, 64)])
def test_links_equal_brute_force(spark, monkeypatch, few, salted):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "SALTED", salted)
    texts = near_copies(3, 2, 40, 6)
    sets = {}
    for i, x in texts.items():
        w = x.split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
    kinds = {*sets.values()}
    near = lambda a, b: 100 * len(a & b) >= 90 * len(a | b)
    want = {i: sum(near(a, b) for b in kinds if b and b != a) if a else 0 for i, a in sets.items()}
    assert max(want.values()) > 5
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {i: r.links for i, r in by_id(jaccard_join.join(docs, 3, 90)).items()} == want


@pytest.mark.parametrize("percent, edits", [(90, 7), (80, 12), (90, 20)])
def test_long_lists_are_taken_apart_without_losing_links(spark, monkeypatch, percent, edits):
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    texts = near_copies(11, 3, 60, edits)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard_join.join(docs, 3, percent)).items()}
    assert got == brute_components(texts, 3, percent)


def test_a_group_below_the_threshold_is_not_enumerated(spark, monkeypatch):
    """A thousand texts, each three words off one origin: any two share most of their words and none are similar."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = {0: " ".join(base)}
    for i in range(1, 1_000):
        w = list(base)
        for k in rng.choice(120, 4, False):
            w[k] = f"new{i}of{k}"
        texts[i] = " ".join(w)
    met = []
    pairs = jaccard_join.similar_pairs
    monkeypatch.setattr(jaccard_join, "similar_pairs", lambda p, *a: met.append(p.count()) or pairs(p, *a))
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = by_id(jaccard_join.join(docs, 3, 90))
    assert {r.component_id for r in got.values()} == set(texts) and {r.links for r in got.values()} == {0}
    assert sum(met) < 20 * len(texts)


def test_texts_that_share_an_id_are_compared_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " end"), (None, c), (None, c + " end"), (None, "quite another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in jaccard_join.distinct_documents(docs).collect()}
    assert {(5, b), (3, a + " end"), rows[5]} < left and (5, a) not in left
    assert len(left) == 4 and len(left & {rows[3], rows[4]}) == 1


def test_components_of_a_path_and_of_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert set(found.values()) == {0, 100} and found[60] == 0 and found[139] == 100
    assert components.components(links.limit(0)).count() == 0


def test_costly_documents_take_longer_prefixes():
    df = np.array([30.0] * 50)
    rare, heavy = np.arange(100, dtype=np.uint64), np.uint64(1 << 63) | np.arange(50, dtype=np.uint64)
    assert jaccard_join.surplus(rare, df, 90) == 1
    assert jaccard_join.surplus(heavy, df, 90) > 1


# 5


def test_warc_round_trip_and_lookup(spark):
    big = "<p>" + "x" * 300
    rows = [(5, "http://b.example.com/q?a=1", big), (2, "https://www.B.example.com/z", big), (7, "http://a.example.org/", "short"), (8, "http://a.example.org/", "short"), (9, None, None), (11, "http://b.example.com/q?a=1", big + "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures, index = warc.build(pages)
    got = by_id(warc.read_back(captures, index), "page")
    assert (got[2].record_type, got[2].refers_to) == ("response", None) and (got[5].record_type, got[5].refers_to) == ("revisit", 2)
    assert got[8].record_type == "response" and got[9].payload_bytes == 0
    assert got[11].payload_digest == hashlib.sha256((big + "ü").encode()).hexdigest() and got[5].payload_bytes == len(big)
    urls = spark.createDataFrame([("https://b.example.com/q?a=1",), ("http://nowhere.example.com/",)], "url string")
    assert sorted((r.page_id, r.html, r.record_type) for r in warc.look_up(urls, index).collect()) == [(5, big, "revisit"), (11, big + "ü", "response")]


def test_pages_that_share_id_and_url_read_their_own_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(1, "http://a.org/x", f"<p>{'y' * n}</p>") for n in (200, 300, 20, 300)] + [(None, f"{s}://a.org/x", s * 60) for s in ("http", "https", "https")] + [(4, None, "y" * 500)] * 9
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type) for r in warc.archived_pages(pages).collect())
    assert got == sorted((p or -1, len(h), hashlib.sha256(h.encode()).hexdigest(), "response") for p, _, h in rows)


def test_index_search_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.example.com/p", f"page {i}") for i in range(60)], "page_id long, url string, html string")
    _, index = warc.build(pages)
    s = warc.Searcher(index)
    key = warc.surt("http://h1.example.com/p")
    assert [c[0] for c in s.captures(key)] == [i for i in range(60) if i % 4 == 1]
    assert [c[0] for c in s.captures(key, 33)] == [33] and not list(s.captures("com,example,zz)/"))


def test_surt():
    assert warc.surt("http://User@WWW.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.surt("https://x.org") == "org,x)/" and warc.surt("http://[bad") == "http://[bad"


# 6


def test_base_scores_and_held_out_perplexity(documents):
    texts = {r.doc_id: common.words_of(r.text or "") + ["\n"] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = collections.Counter(w for i, x in texts.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    got = by_id(pitman_yor.score(documents))
    for i, x in texts.items():
        assert got[i].base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(x), sum(w in c for w in x), n)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_packed_keys_come_back():
    rng = np.random.default_rng(2)
    for top, n in ((1 << 42, 5), (1 << 63, 400), (100, 0), (1 << 42, 1), (10_000, 300)):
        keys = np.sort(rng.integers(0, top, n).astype(np.uint64))
        assert pitman_yor.unpacked(pitman_yor.packed(keys)).tolist() == keys.tolist()
    u, w = rng.integers(0, 1 << 21, 500), rng.integers(0, 1 << 21, 500)
    got = pitman_yor.numbers(pitman_yor.numbered(u, w))
    assert (got[0] == u).all() and (got[1] == w).all()


def test_seating_is_within_bounds():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, pitman_yor.COUNTED, pitman_yor.COUNTED + 1, 100_000, 10**9])
    for p, others in ((0.1, 0), (1e-9, 10**6), (1.0, 0), (0.5, 10**8)):
        for d in (0.05, 0.5, 0.95):
            for t in pitman_yor.tables_of(c, np.full(len(c), p), 1.0, d, np.full(len(c), others), rng):
                assert t[:2].tolist() == [0, 1] and (t <= c).all() and (t[1:] >= 1).all()
    assert pitman_yor.tables_of(c[:0], c[:0] * 0.5, 1.0, 0.5, c[:0], rng).shape == (pitman_yor.SWEEPS, 0)


@pytest.mark.parametrize("theta, p, others, d", [(0.3, 0.4, 2, 0.5), (2.0, 0.9, 0, 0.8)])
def test_seating_has_the_exact_distribution(theta, p, others, d):
    """Of four customers of a dish, by enumeration of all ways to sit: a new table has (theta + d * tables) * p, and a seat at
    a table of k customers k - d."""
    def ways(left, tables):
        if not left:
            yield tables
            return
        yield from ways(left - 1, [*tables, 1])
        for i in range(len(tables)):
            yield from ways(left - 1, [*tables[:i], tables[i] + 1, *tables[i + 1 :]])

    exact = np.zeros(5)
    for tables in ways(4, []):
        new = np.prod([(theta + d * (others + k)) * p for k in range(len(tables))])
        exact[len(tables)] += new * np.prod([np.prod([k - d for k in range(1, n)]) for n in tables])
    rng, size = np.random.default_rng(1), 40_000
    for t in pitman_yor.tables_of(np.full(size, 4), np.full(size, p), theta, d, np.full(size, others), rng):
        assert np.allclose(np.bincount(t, minlength=5) / size, exact / exact.sum(), atol=0.012)


def ways_by_recursion(c, d, most):
    out, t = np.full(most + 1, -np.inf), np.arange(1, most + 1)
    out[0] = 0
    for k in range(c):
        out[1:] = np.logaddexp(out[:-1], np.log(np.maximum(k - d * t, 1e-300)) + out[1:])
        out[0] = -np.inf
    return out[1:]


@pytest.mark.parametrize("d", [0.05, 0.3, 0.5, 0.7, 0.95])
def test_ways_beyond_the_counted_ones(d):
    """The corrected saddle point has the ratios of neighbours that the recursion has, and no holes at any size."""
    for c in (pitman_yor.COUNTED + 1, 3_000):
        t = np.arange(1.0, 301)
        got = pitman_yor.saddle_ways(np.full(300, float(c)), t, d)
        assert np.abs(np.diff(got) - np.diff(ways_by_recursion(c, d, 300))).max() < 0.01
    assert np.isfinite(pitman_yor.corrections(d)).all()


@pytest.mark.parametrize("c, p, theta, others", [(401, 0.01, 5.0, 300), (3_000, 0.001, 50.0, 30_000), (3_000, 0.9, 1.0, 0)])
def test_dishes_of_many_customers_have_the_exact_distribution(c, p, theta, others, d=0.7):
    t = np.arange(1, min(c, 1_500) + 1)
    w = ways_by_recursion(c, d, len(t)) + np.cumsum(np.log(theta / d + others + t - 1)) + t * np.log(d * p)
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    mean = (w * t).sum()
    sd = np.sqrt((w * (t - mean) ** 2).sum())
    got = pitman_yor.tables_of(np.full(4_000, c), np.full(4_000, p), theta, d, np.full(4_000, others), np.random.default_rng(4))
    assert abs(got.mean() - mean) < 4 * sd / np.sqrt(got.size) + 0.004 * mean
    assert got.std() == pytest.approx(sd, rel=0.05)


@pytest.mark.parametrize("hot", [5_000, 30])
def test_scores_equal_a_plain_model_with_the_same_seating(spark, monkeypatch, hot):
    """All texts by dictionaries, where the seating is a rule: every pair of three and more customers has two tables."""
    def seated(c, t, tables, p, theta, d, rng):
        t = np.minimum(c, 1 + (c > 2))
        return t, pitman_yor_sweeps * t

    def at_root(c, t, base, theta, d, tables, rng):
        return np.minimum(c, 1 + (c > 3))

    pitman_yor_sweeps = pitman_yor.SWEEPS
    for name, value in (("HOT", hot), ("COMMON_PAIRS", 20), ("one_round", seated), ("root_tables", at_root), ("strength", lambda *x: 2.0)):
        monkeypatch.setattr(pitman_yor, name, value)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    odds = 1 / np.arange(1, 121)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)), p=odds / odds.sum())) + (f" only{i}" if i % 3 == 0 else "")) for i in range(90)] + [(500, None), (501, "")]
    texts = {i: [w.decode() for w in (t or "").encode().lower().split()] + [""] for i, t in rows}  # "" is the end
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = collections.Counter((u, w) for i, x in texts.items() if not held[i] for u, w in zip(["", *x], x))
    n, word = collections.Counter(), collections.Counter()
    tables, customers = collections.Counter(), collections.Counter()
    for (u, w), k in c.items():
        n[u] += k
        word[w] += k
        tables[u] += 1 + (k > 2)
        customers[w] += 1 + (k > 2)
    n1, n2 = (sum(k == x for k in c.values()) for x in (1, 2))
    d, theta, d_root = min(0.95, max(0.05, n1 / (n1 + 2 * n2))), 2.0, 0.5
    at = {w: min(k, 1 + (k > 3)) for w, k in customers.items()}
    whole = theta + sum(customers.values())
    fresh = (theta + d_root * sum(at.values())) / whole / (len(word) + 1)
    root = lambda w: (customers[w] - d_root * at[w]) / whole + fresh if w in at else fresh

    def chance(u, w):
        if not n[u]:
            return root(w)
        k = c[u, w]
        return ((k - d * (1 + (k > 2))) if k else 0) / (theta + n[u]) + (theta + d * tables[u]) / (theta + n[u]) * root(w)

    got = by_id(pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert len(got) == len(rows)
    for i, x in texts.items():
        assert got[i].score == pytest.approx(sum(np.log10(chance(u, w)) for u, w in zip(["", *x], x)), rel=1e-5)


@pytest.mark.parametrize("hot", [5_000, 400])
def test_all_contexts_decide_and_predictions_sum_to_one(spark, monkeypatch, hot):
    monkeypatch.setattr(pitman_yor, "HOT", hot)
    monkeypatch.setattr(pitman_yor, "COMMON_PAIRS", 500)
    rng = np.random.default_rng(8)
    words = [f"r{i}" for i in range(1_500)]
    rows = [(i, " ".join(f"{w} after{w}" for w in rng.choice(words, 60)) + f" only{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = docs.where(common.held_out(F.col("doc_id"), pitman_yor.FOLDS))
    model, counts = pitman_yor.fit(docs.join(out, "doc_id", "left_anti"))
    assert model.tail == (hot == 400) and counts.count() > 2_800  # each a context, more than any 1,000 classes
    kept, rest = range(len(model.a)), model.rest.collect()
    assert len(kept) == pitman_yor.ROUNDS - pitman_yor.BURN_IN > 1
    by_context = np.zeros((len(kept), len(model.words.n)))  # what the pairs of numbered words and the others add, by round's mean
    got = np.zeros(len(model.words.n))
    for r in model.pairs.collect():
        u, _ = pitman_yor.numbers(pitman_yor.unpacked(r["x"]))
        if r["kind"] == pitman_yor.PAIRS:
            np.add.at(got, u, pitman_yor.array_of(r["b"], "<f4").astype(float))
        else:
            np.add.at(got, u, sum((1 - model.d) / (th + model.words.n[u]) for th in model.thetas))
    for r in model.others.collect():
        u = model.words.of(np.array([r["before"]]).view(np.uint64))[0]
        if u >= 0:
            got[u] += sum((1 - model.d) / (th + model.words.n[u]) for th in model.thetas) if r["c"] == 1 else r["b"]
    for k in kept:
        root = model.p[k].sum() + sum(r[f"p_{k}"] for r in rest) + model.fresh[k]
        assert root == pytest.approx(1, abs=1e-6)
        by_context[k] = model.a[k] * root
    assert np.allclose((got + by_context.sum(0)) / len(kept), 1, atol=1e-5)
    found = pitman_yor.score(docs).where("held_out").toPandas()
    # a word of some 10 in 15,000 is told by the word before it: half of the tokens are nearly sure
    assert found["score"].sum() > 0.7 * found["base_score"].sum()


# 7


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(int(rng.integers(1, 6)))]
        bad = i % 4 == 0
        if bad:
            sentences[int(rng.integers(0, len(sentences)))] += " vileword"
        rows.append((i, ". ".join(sentences) + "."))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = by_id(toxicity.detect(docs, labels))
    out = [i for i, r in found.items() if r.held_out]
    assert np.mean([found[i].predicted == marks[i][1] for i in out]) > 0.95
    for i in out:
        if found[i].predicted:
            spans = [tuple(map(int, s.split(":"))) for s in found[i].offending.split(",")]
            assert len(spans) == 1 and "vileword" in rows[i][1][slice(*spans[0])]
    assert {r.doc_id for r in toxicity.harmless_documents(docs, labels).collect()} == {i for i, r in found.items() if r.score < toxicity.THRESHOLD}


def test_noisy_or_and_gradient():
    assert toxicity.noisy_or(np.array([0.0, 0.0])) == pytest.approx(0.75)
    assert toxicity.noisy_or(np.array([800.0])) == 1 and toxicity.noisy_or(np.array([-800.0])) == 0
    model = toxicity.fit_noisy_or(*map(np.array, ([1, 0, 1, 0], [2, 2, 1, 1], [1, 1, 1, 0], [0, 1, 0], [0, 1, 0])), ["bad", "fine"])
    assert model.weights["bad"] > 0 > model.weights["fine"] and model.bias < 0


def test_sentences_and_spans_agree():
    scorer = toxicity.Scorer(toxicity.Model(-1.0, {"bad": 2.0}))
    for text in ("One bad. Two!\n\nThree", "...", "", "no end", "bad.bad? 12 ."):
        assert len(scorer.sentences(text)) == max(1, len(toxicity.sentence_spans(text)))
    assert scorer.sentences("One bad. Two") == pytest.approx([1.0, -1.0])


# 8


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["İstanbul ΣΑΣ don't WE'RE x²½ 12345 <|startoftext|>hi<|endoftext|> <|", "\x1c a\x00b​ ñ 日本語 😀 'LL", "x" * 700, "ab" * 500 + " ٣٤ ⅷ ªº", "\x85 "]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, path, with_ids=True).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_single_and_batched_trees_merge_alike():
    b = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"thean"), int(n))) for n in rng.integers(1, 40, 300)]
    assert [x.tolist() for x in b.merge(words)] == [b._merge_one(w, max(2, 1 << (len(w) - 1).bit_length())).tolist() for w in words]


# 9


def test_language_of_documents_and_pages(spark, documents):
    pages = common.table(spark, SF, "pages")
    found = language.identify(documents, pages).toPandas()
    truth = documents.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    docs = found[found.doc_id.notna()]
    assert len(docs) == len(truth) and (truth.loc[docs.doc_id.astype(int)].to_numpy() == docs.lang.to_numpy()).mean() > 0.95
    on_pages = found[found.page_id.notna()]
    assert len(on_pages) == pages.count() and (on_pages.lang == on_pages.declared).mean() > 0.95
    assert found.confidence.between(0, 1 + 1e-9).all()


def test_other_evidence_decides_without_text(spark, documents):
    rows = [(i, f"http://h.example.de/{i}", f'<html lang="de"><p>{"der die und das ist nicht ein schöner Tag mit der " * 3}') for i in range(20)]
    rows.append((99, "http://h.example.de/empty", "<html><p>"))
    found = by_id(language.identify(documents, spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id IS NOT NULL"), "page_id")
    assert found[99].lang == "de"


# 10


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 16))))) for i in range(8)] + [(8, None), (9, "--"), (10, "T1, t2; T3!")]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(40)]
    docs += [(100, "x " + items[0][1].upper() + " y " + items[3][1]), (101, items[0][1] + " " + items[0][1])]
    tokens = lambda x: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    found = by_id(decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    for i, x in docs:
        w, hit, ids = tokens(x), set(), set()
        for item, y in items:
            q = tokens(y)
            for k in range(max(1, len(q) - 9)) if q else ():
                part = q[k : k + 10]
                for s in range(len(w) - len(part) + 1):
                    if w[s : s + len(part)] == part:
                        hit |= {*range(s, s + len(part))}
                        ids.add(str(item))
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "red fox jumps over dogs"), (2, "red quick fox jumps"), (3, "red a b c d e fox jumps")], "doc_id long, text string")
    pattern = decontaminate.windows(spark.createDataFrame([(1, "red fox jumps")], "item_id long, text string")).select("win_id", "terms")
    index = decontaminate.build_index(docs, pattern.select(F.explode("terms").alias("term")).distinct())
    assert {r.doc for r in decontaminate.occurrences(index, pattern).collect()} == {1}
    assert {r.doc for r in decontaminate.near_occurrences(index, pattern, 0).collect()} == {1}
    assert {r.doc for r in decontaminate.near_occurrences(index, pattern, 1).collect()} == {1, 2}
    assert {r.doc for r in decontaminate.near_occurrences(index, pattern, 6).collect()} == {1, 2, 3}


def test_texts_that_share_an_id_are_searched_each(spark):
    half = [" ".join(LOREM.split()[:5]), " ".join(["x"] * 5 + LOREM.split()[5:10])]
    whole = " ".join(LOREM.split()[:10])
    rows = [(None, half[0]), (None, half[1]), (7, half[0]), (7, half[1]), (None, whole), (8, whole), (8, "fine"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, whole)], "item_id long, text string")
    found = decontaminate.decontaminate(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in found if r.contaminated) == [("8", 10, 10), ("None", 10, 10)]
    assert len(found) == len(rows) and all(r.n_hit <= r.n_words for r in found)
    left = sorted(map(repr, (tuple(r) for r in decontaminate.clean_documents(docs, items).collect())))
    assert left == sorted(map(repr, [r for r in rows if r[1] != whole]))


def test_near_matches_are_returned_for_whole_tables(spark):
    w = LOREM.split()[:10]
    moved = [*w[:4], "inserted", *w[4:]]
    rows = [(1, " ".join(w)), (2, " ".join(moved)), (3, " ".join(w[:9])), (4, None), (None, " ".join(moved)), (5, " ".join([*w[:3], *"a b c d e f".split(), *w[3:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w)), (2, "never there"), (3, " ".join(w))], "item_id long, text string")
    found = sorted((str(r.doc_id), r.n_near, r.near_items) for r in decontaminate.near_matches(docs, items).collect())
    assert found == [("1", 1, "1,3"), ("2", 1, "1,3"), ("3", 0, ""), ("4", 0, ""), ("5", 0, ""), ("None", 1, "1,3")]
    exact = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items).collect()}
    assert exact[1] == 10 and exact[2] == 0


def test_near_matches_are_a_query():
    from tierwright.llm import queries

    assert queries.queries()["op10_near_matches"] is decontaminate.near_query
