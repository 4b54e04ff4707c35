"""Quality, language, toxicity, LM scores, near-duplicates and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from samples import bag, clashing, docs, rows

import corpus_pipeline
from sessora.llm import languages, neardups, quality, queries, scoring, shingles, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def empty(spark):
    return docs(spark, [])


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# --- quality


def test_isotonic_is_the_nearest_rising_sequence():
    found = quality.isotonic(np.array([0.1, 0.5, 0.2, 0.3, 0.9, 0.8]), np.array([1, 1, 1, 2, 1, 1.0]))
    assert np.allclose(found, [0.1, 0.325, 0.325, 0.325, 0.85, 0.85])


def test_normal_equations_equal_one_matrix(spark, table, labels):
    known = quality.measured(table.limit(60)).selectExpr("stats", "cast(doc_id % 2 as int) quality", "doc_id % 2 half")
    data = known.toPandas()
    stats = np.array(data["stats"].tolist())
    mean, spread = stats.mean(0), stats.std(0) + 1
    sums = quality.normal_equations(known, mean, spread)
    for h in (0, 1):
        part = data["half"] == h
        z = np.c_[quality.cosines(stats[part], mean, spread), data["quality"][part]]
        assert np.allclose(sums[h], z.T @ z)


def test_quality_held_out(spark, labels):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = queries.op1_quality_classifier(spark, SF).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_awkward(spark, labels):
    model = quality.fit(docs(spark), no_labels(spark))
    assert {r.score for r in quality.score(docs(spark), model).collect()} == {0.5}
    some = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (3, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark)
    model = quality.fit(frame, some)
    assert quality.score(frame, model).count() == len(rows())
    clash = clashing(frame, "score", "predicted", "stats", "half", "quality")
    assert bag(quality.score(clash, quality.fit(clash, some))) == bag(quality.score(frame, model))
    assert quality.accepted(clash, model).columns == clash.columns
    assert quality.score(empty(spark), quality.fit(empty(spark), some)).count() == 0


# --- languages


def plain_probability(counts, alphabet, gram):
    """Interpolated Kneser-Ney by its definition."""
    order = len(gram)
    if not order:
        return 1 / (alphabet + 1)
    tables = {languages.ORDER: counts}
    for n in range(languages.ORDER - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    table = tables[order]
    n1, n2 = (sum(c == k for c in table.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    after = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
    lower = plain_probability(counts, alphabet, gram[1:])
    if not after:
        return lower
    return (max(table.get(gram, 0) - d, 0) + d * len(after) * lower) / sum(after.values())


def grams_of(text):
    points, _ = languages.joined([text])
    line = "".join(map(chr, points))
    return [line[i : i + languages.ORDER] for i in range(len(line) - languages.ORDER + 1)]


def test_models_equal_definition():
    texts = {"a": "banana bandana cabana", "b": "the cat sat on that mat"}
    counts = {k: dict(Counter(grams_of(t))) for k, t in texts.items()}
    models = languages.build(counts)
    alphabet = len({c for t in counts.values() for g in t for c in g})
    scorer = models.open()
    for text in ("banana that", "zebra", "on a mat é", "x"):
        found = scorer.entropies([text])[0]
        for i, name in enumerate(models.languages):
            logs = [math.log(plain_probability(counts[name], alphabet, g)) for g in grams_of(text)]
            assert abs(found[i] + sum(logs) / len(logs)) < 1e-4


def test_sorted_hashes():
    rng = np.random.default_rng(3)
    have = np.sort(rng.integers(0, 1 << languages._BITS, 5000).astype(np.uint64))
    asked = np.concatenate([have[::7], rng.integers(0, 1 << languages._BITS, 500).astype(np.uint64)])
    found = languages.SortedHashes(have).find(asked)
    known = {int(h) for h in have}
    assert all((f >= 0) == (int(a) in known) and (f < 0 or have[f] == a) for f, a in zip(found, asked))


def test_languages_held_out(spark, table):
    truth = {r.doc_id: r.lang for r in table.collect()}
    found = queries.op5_language_id(spark, SF).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in found) <= 5


def test_languages_awkward(spark, table):
    models = languages.fit(table)
    found = {r.doc_id: r for r in languages.predict(docs(spark), models).collect()}
    assert found[6].lang_pred == found[9].lang_pred == "und" and found[6].rejected
    assert found[0].lang_pred in models.languages
    strange = docs(spark, [(1, "ЖЩЪ ЫЭЮ ЯЦЧ ШЖЩЪ ЫЭЮЯ" * 40, None, None, None)])
    assert languages.predict(strange, models).first().rejected
    none = languages.fit(empty(spark))
    assert {(r.lang_pred, r.rejected) for r in languages.predict(docs(spark), none).collect()} == {("und", False)}
    clash = clashing(docs(spark), "lang_pred", "score", "gram", "rejected")
    assert bag(languages.predict(clash, models)) == bag(languages.predict(docs(spark), models))
    assert languages.accepted(clash, models).columns == clash.columns
    assert languages.predict(empty(spark), models).count() == 0


def language_rows(rng, lang, n, first, words):
    return [(first + i, " ".join(rng.choices(words, k=60)), lang, "s", 0) for i in range(n)]


def test_languages_all_have_a_limit(spark):
    """Before, a language of few rows, and every language of a small table, rejected nothing."""
    rng = random.Random(8)
    rare = language_rows(rng, "bb", 8, 9000, ["ovo", "uvu", "vovu", "luvo"])
    data = language_rows(rng, "aa", 500, 0, ["banana", "cabana", "bandana", "panama", "drama"]) + rare
    strange = docs(spark, [(1, "uxq ovwz gjy kzqx ghwv " * 40, None, None, None)])
    for rows_ in (data, rare):
        models = languages.fit(docs(spark, rows_))
        assert np.isfinite(models.limits).all() and models.languages == sorted({r[2] for r in rows_})
        assert languages.predict(strange, models).first().rejected
        kept = languages.predict(docs(spark, rows_), models).where("not rejected").count()
        assert kept >= 0.99 * len(rows_)
    sample, others = languages.split(docs(spark, data), 10**9)
    texts = {r.text for r in sample.collect()}
    assert others.count() and not any(r.text in texts for r in others.collect())


def test_language_sample_takes_pieces(spark):
    """Before, one very long document was taken whole or pushed out all others of its language."""
    rng = random.Random(9)
    words = ["ovo", "uvu", "vovu", "luvo"]
    data = language_rows(rng, "aa", 300, 0, ["banana", "cabana", "bandana"])
    data += language_rows(rng, "bb", 29, 9000, words)
    giants = [n for n in range(9100, 9200) if zlib.crc32(str(n).encode()) % 4 != 2]
    for giant in giants[:4]:
        frame = docs(spark, [*data, (giant, " ".join(rng.choices(words, k=200_000)), "bb", "s", 0)])
        sample, _ = languages.split(frame, 100_000)
        chars = Counter()
        for r in sample.collect():
            chars[r.lang] += len(r.text)
        assert set(chars) == {"aa", "bb"} and chars["bb"] <= 150_000
    assert languages.fit(frame, 100_000).languages == ["aa", "bb"]
    whole, _ = languages.split(docs(spark, [(giants[0], "é" * 4_500, "bb", "s", 0)]), 10**9)
    assert [r.text for r in whole.collect()] == ["é" * 4_500]


# --- toxicity


def test_chain_learns_each_category():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 6)) < 0.2).astype(float)
    labels = np.stack([x[:, 0], x[:, 1], np.maximum(x[:, 0], x[:, 1])], axis=1)
    chain = toxicity.Chain(list("abcdef"), toxicity.train_chain(x, labels, np.arange(400) % toxicity.FOLDS))
    found = chain.probabilities(x)
    assert ((found >= 0.5) == (labels >= 0.5)).mean() > 0.99
    assert [len(w) for w in chain.weights] == [7, 8, 9]


def test_toxicity_held_out(spark, table, labels):
    chain = toxicity.fit(table, labels.where("doc_id % 3 <> 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    found = {r.doc_id: r.predicted for r in toxicity.score(table, chain).collect()}
    assert len(found) == 1000
    caught = [found[i] for i, t in truth.items() if t]
    assert sum(caught) >= 0.6 * len(caught)
    assert sum(found[i] for i, t in truth.items() if not t) <= 0.02 * len(truth)


def test_toxicity_awkward(spark, labels):
    chain = toxicity.fit(docs(spark), no_labels(spark))
    assert all(r.score < 0.01 for r in toxicity.score(docs(spark), chain).collect())
    some = spark.createDataFrame([(0, 1, 0), (21, 1, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark)
    clash = clashing(frame, "score", "predicted", "words", "toxic", "p_insult")
    assert bag(toxicity.score(clash, toxicity.fit(clash, some))) == bag(toxicity.score(frame, toxicity.fit(frame, some)))
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), some)).count() == 0


# --- LM scores


def test_gradient_step_lowers_the_loss():
    words = ["a", "b", "c"]
    shares = np.full(scoring.TOKENS, 1 / scoring.TOKENS)
    network, tokens = scoring.Network.start(words, shares), scoring.Tokens(words)
    target, context, sizes = tokens.rows(["a b c " * 50, "", "c b a"])
    assert sizes.tolist() == [150, 0, 3]
    assert context[0].tolist() == [scoring.EDGE, scoring.EDGE, 1, 2] and target[0] == 0
    flat, losses = network.flat().astype(np.float64), []
    for _ in range(30):
        losses.append(-network.log_likelihoods(target, context).mean())
        network.step(target, context, 5.0)
    assert losses[-1] < 0.2 * losses[0]
    # the step against a numeric gradient of one weight in each part
    start = network.filled(flat)
    moved = start.copy()
    moved.step(target, context, 1e-2)
    for cell in (5, start.inputs.size + 3, len(flat) - 4):
        up, down = flat.copy(), flat.copy()
        up[cell] += 1e-2
        down[cell] -= 1e-2
        loss = lambda f: -start.filled(f).log_likelihoods(target, context).mean()
        slope = (loss(up) - loss(down)) / 2e-2
        assert abs((flat[cell] - moved.flat()[cell]) / 1e-2 - slope) < 2e-3 + 0.05 * abs(slope)


def test_lm_rows(spark, table):
    network = scoring.fit(table)
    counts = Counter(w for r in table.collect() for w in r.text.lower().split())
    assert network.words == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: scoring.WORDS]]
    found = {r.doc_id: r for r in scoring.score(table, network).collect()}
    tokens = scoring.Tokens(network.words)
    for r in table.limit(20).collect():
        target, context, _ = tokens.rows([r.text])
        assert abs(found[r.doc_id].log_likelihood - network.log_likelihoods(target, context).sum()) < 1e-3
        assert found[r.doc_id].n_tokens == len(r.text.split())


def test_lm_awkward(spark):
    frame = docs(spark)
    network = scoring.fit(frame)
    found = {r.doc_id: r for r in scoring.score(frame, network).collect()}
    assert found[6].n_tokens == 0 and found[6].mean_log_likelihood is None and found[6].log_likelihood == 0
    clash = clashing(frame, "n_tokens", "word", "n", "log_likelihood")
    assert bag(scoring.score(clash, network)) == bag(scoring.score(frame, network))
    none = scoring.fit(empty(spark))
    assert scoring.score(empty(spark), none).count() == 0 and scoring.score(frame, none).count() == len(rows())


def test_lm_gives_every_word_a_probability(spark):
    """Words beyond those with a token of their own, alike in ending, differ by their counts."""
    rng = random.Random(4)
    usual = [f"w{i}" for i in range(scoring.WORDS)] * 4
    data = [(i, " ".join(rng.choices(usual, k=60) + ["walking"] * (i % 4 == 0)), "en", "s", 0) for i in range(60)]
    data += [(100, "w1 w2 walking w3 w4", "en", "s", 0), (101, "w1 w2 zqxvjing w3 w4", "en", "s", 0)]
    frame = docs(spark, [*data, (102, None, "en", "s", 0), (None, "w1 w2 walking", "en", "s", 0)])
    network = scoring.fit(frame)
    found = {r.doc_id: r for r in scoring.score_corpus(frame).collect()}
    assert len(found) == 64 and found[102].log_likelihood == 0 and found[102].mean_log_likelihood is None
    # before, both had the probability of the bucket
    counts = Counter(w for r in frame.collect() for w in (r.text or "").split())
    gap = math.log(counts["walking"] / counts["zqxvjing"])
    assert abs(found[100].log_likelihood - found[101].log_likelihood - gap) < 1e-3
    tokens = scoring.Tokens(network.words)
    sums = Counter()
    for w, n in counts.items():
        sums[int(tokens.of(w)[0])] += n
    assert all(network.totals[t] == n for t, n in sums.items()) and network.totals.sum() == counts.total()
    target, context, _ = tokens.rows([data[-1][1]])
    token = int(tokens.of("zqxvjing")[0])
    plain = network.log_likelihoods(target, context).sum() + math.log(1 / sums[token])
    assert abs(found[101].log_likelihood - plain) < 1e-3


# --- near-duplicates


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(data, width, num):
    sets = {d: shingle_set(t, width) for d, t in data}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = Counter(e for x in s for e in holders[x] if e < d)
        for e, k in shared.items():
            if 100 * k >= num * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def found_components(frame, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardups.near_duplicates(frame, **options).collect()}


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for n, k in ((1000, 800), (200, 150), (20, 15), (1, 1)):
        a, b = pool[:n], pool[n - k : 2 * n - k]
        x, y = shingles.signatures([a, b], 400)
        assert abs((x == y).mean() - k / (2 * n - k)) < 0.1
        assert (shingles.super_minhash([a], 400)[0] == x).all()


def test_least_rank_comes_first():
    one = shingles.super_minhash([np.array([7], np.uint64)], 50)[0] >> np.uint64(shingles._ROUND_BITS)
    assert sorted(one.tolist()) == list(range(50))  # one element: a permutation of the ranks


@given(st.text(alphabet="aB \t\n\x0bé ", max_size=40), st.sampled_from([2, 3, 5]))
@settings(max_examples=100, deadline=None)
def test_shingle_sets(text, width):
    assert len(shingles.shingle_sets([text], width)[0]) == len(shingle_set(text, width))


def chains(rng):
    """Groups of near copies, many of them at the edge of the threshold, and a passage that all share."""
    passage = [f"p{i}" for i in range(40)]
    data = []
    for group in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for copy in range(60):
            words = list(base)
            for _ in range(rng.randrange(0, 8)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            data.append(" ".join(words))
    for _ in range(60):
        data.append(" ".join(passage + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 14))]))
    rng.shuffle(data)
    return [(i, t) for i, t in enumerate(data)]


@pytest.mark.parametrize("leaders,cut", [(2, 7), (256, 1_000)])
def test_rounds_lose_no_link(spark, monkeypatch, leaders, cut):
    monkeypatch.setattr(neardups, "LEADERS", leaders)
    monkeypatch.setattr(neardups, "CUT_ROWS", cut)
    data = chains(random.Random(4))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert found_components(frame, width=3, num=85, den=100) == plain_components(data, 3, 85)


def test_near_duplicates_whole_table(spark, table):
    data = [(r.doc_id, r.text) for r in table.collect()]
    assert found_components(table) == plain_components(data, 5, 80)


def test_groups_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500 + i, 1000) for i in range(50)] + [(1000, 2000)]
    random.Random(2).shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(8)
    found = {r.node: r.comp for r in neardups.groups(frame).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {i: 500 for i in [*range(501, 550), 1000, 2000]}


def test_near_duplicates_awkward(spark):
    frame = docs(spark)
    found = neardups.near_duplicates(frame)
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows())
    assert by_id[21].component_id == 0 and not by_id[21].kept
    assert by_id[6].n_shingles == 0 and by_id[6].kept and by_id[6].component_id == 6
    assert by_id[None].component_id is None and by_id[None].kept
    clash = clashing(frame, "node", "key", "bands", "comp", "kept", "bucket")
    assert bag(neardups.near_duplicates(clash)) == bag(found)
    kept = neardups.deduplicated(clash)
    assert kept.columns == clash.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r[0] for r in rows()} - {21})
    assert neardups.near_duplicates(empty(spark)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, table):
    frame, counts = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == table.columns
        counts.append(frame.count())
    quality_left = {r.doc_id for r in queries.op1_quality_classifier(spark, SF).where("predicted = 1").collect()}
    assert counts[0] == len(quality_left) and counts[2] < counts[1] <= counts[0] and counts[3] == counts[2]
    data = [(r.doc_id, r.text) for r in frame.collect()]
    groups = plain_components(data, 5, 80)
    assert all(d == c for d, (_, c) in groups.items()) or len(data) - len({c for _, c in groups.values()}) <= 3
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {d for d, _ in data}


def test_pipeline_awkward(spark):
    clash = clashing(docs(spark), "__note", "score", "spans", "key")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, clash, SF)
        if name != "packing":
            assert found.columns == clash.columns
        assert found.count() >= 1
        assert stage(spark, empty(spark), SF).count() == 0


# --- stages over columns with helper-like names, repeated ids


def test_stages_leave_columns_of_any_name_alone(spark):
    from sessora.llm import languages, quality, secrets

    names = ("__good", "__out", "__clean", "__note", "value", "row", "kept", "_0", "pythonUDF0")
    frame = clashing(docs(spark), *names)
    labels = spark.createDataFrame([(0, 1, 0), (15, 0, 0)], "doc_id long, quality int, toxic int")
    good = quality.accepted(frame, quality.fit(frame, labels))
    kept = languages.accepted(frame, languages.fit(frame))
    clean = secrets.redacted(frame)
    for found in (good, kept, clean):
        assert found.columns == frame.columns
        assert found.where("__good <> 'clash' or pythonUDF0 <> 'clash'").count() == 0
    assert clean.count() == frame.count()


def test_rows_of_one_id_with_other_texts_stay(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, words(1)), (1, words(2)), (1, words(2)), (2, words(3)), (3, words(3)), (None, words(3))]
    frame = docs(spark, [(i, t, "en", f"s{n}", 1) for n, (i, t) in enumerate(rows)])
    found = neardups.deduplicated(clashing(frame, "row", "kept", "node"))
    assert sorted((str(r.doc_id), r.text, r.source) for r in found.collect()) == sorted(
        [("1", words(1), "s0"), ("1", words(2), "s1"), ("2", words(3), "s3"), ("None", words(3), "s5")]
    )
