"""What the fitted models report, recomputed from their own evidence or counts by hand."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexispark.llm import lm_katz, quality_classifier, quality_rules, sharding

GOOD = "the river runs past quiet hills and farms where people tell long stories about rain and harvest every year number {}"
BAD = "$$$ BUY!!! NOW 1234 *** 5678 CHEAP CHEAP CHEAP ### 99 | {} | !!! $$$ WIN WIN WIN"


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def moments(groups):
    """(common mean, prior strength) of lists of probabilities by group: between-group variance from grouped sums."""
    count = sum(map(len, groups))
    total = sum(map(sum, groups))
    mean = min(max(total / count, 1e-6), 1 - 1e-6)
    within = sum(sum(p * p for p in g) - sum(g) ** 2 / len(g) for g in groups)
    between = sum(sum(g) ** 2 / len(g) for g in groups)
    noise = max(within, 0) / max(count - len(groups), 1)
    spread = (between - total * total / count - (len(groups) - 1) * noise) / max(count - sum(len(g) ** 2 for g in groups) / count, 1e-9)
    return mean, min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1), 1e6)


def site_rows(spark, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(400):
        host = f"h{rng.choice([0, 0, 0, 1, 2, 3, 3, 4])}"
        good = rng.random() < {"h0": 0.9, "h1": 0.1, "h2": 0.5, "h3": 0.2, "h4": 0.95}[host]
        words = (GOOD if good else BAD).format(i).split()
        if rng.random() < 0.3:
            words = words[: rng.randint(3, 12)]
        rows.append((i, " ".join(words), host, rng.choice(["a", "b", "c"])))
        if i % 2:
            labels.append((i, int(good if rng.random() < 0.9 else not good)))
    rows += [(400, None, "lonely", "a"), (401, "", None, None), (402, GOOD, None, "a"), (403, BAD, "h0", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_posteriors_shrink_sites_towards_their_hosts_and_hosts_towards_all(spark):
    docs, labels = site_rows(spark)
    got = quality_classifier.quality_scores(docs, labels).collect()
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r.host].append(sigmoid(r.evidence))
        paths[r.host, r.path].append(sigmoid(r.evidence))
    mean, host_strength = moments(list(hosts.values()))
    _, path_strength = moments(list(paths.values()))
    assert 1 <= host_strength < 100 and 1 <= path_strength
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        p, h, s = sigmoid(r.evidence), hosts[r.host], paths[r.host, r.path]
        # a document's own evidence is left out of its site's
        host = (host_strength * mean + sum(h) - p) / (host_strength + len(h) - 1)
        path = (path_strength * host + sum(s) - p) / (path_strength + len(s) - 1)
        quality = sigmoid(r.evidence + logit(path) - logit(mean))
        for value, want in ((r.host_posterior, host), (r.path_posterior, path), (r.quality, quality)):
            assert math.isclose(value, want, rel_tol=1e-6, abs_tol=1e-9)
        assert r.kept == (r.quality >= 0.5)


def test_a_site_decides_where_a_document_says_little(spark):
    """The same text is kept on a good site and rejected on a bad one, and follows its own evidence on a site of its own."""
    docs, labels = site_rows(spark)
    rows = [(1000 + i, t.format(i), host, "x") for host, t, k in (("good", GOOD, 0), ("bad", BAD, 100)) for i in range(k, k + 40)]
    weak = [" ".join(GOOD.split()[:k] + BAD.split()[:j]) for k in range(1, 9) for j in range(1, 7)]
    rows += [(2000 + 10 * i + k, t, host, "x") for i, t in enumerate(weak) for k, host in enumerate(("good", "bad", f"own{i}"))]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs.unionByName(more), labels).collect()}
    three = [[got[2000 + 10 * i + k] for k in range(3)] for i in range(len(weak))]
    assert all(g.evidence == b.evidence == o.evidence and g.quality > o.quality > b.quality for g, b, o in three)
    assert any(g.kept and not b.kept for g, b, _ in three)
    # sparse sites lean on the common mean: their posterior lies between the two large ones
    assert all(b.path_posterior < o.path_posterior < g.path_posterior for g, b, o in three)


def test_quality_scores_ignore_columns_of_other_tables(spark):
    docs, labels = site_rows(spark)
    clash = docs.withColumn("host", F.lit("x")).withColumn("_t", F.lit(1)).withColumn("evidence", F.lit(2)).withColumn("p", F.lit(3)).withColumn("n", F.lit(4))
    same = lambda df: sorted((str(r.doc_id), round(r.quality, 9)) for r in df.collect())
    assert same(quality_classifier.quality_scores(clash, labels)) == same(quality_classifier.quality_scores(docs, labels))
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


def repeats(words, least):
    """(words covered by substrings of at least `least` words that occur twice, the longest repeat)."""
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(i):
            k = 0
            while i + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                covered |= set(range(i, i + k)) | set(range(j, j + k))
    return len(covered), longest


def test_verdict_of_the_repetition_rule(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    fresh = lambda n: [word() for _ in range(n)]
    texts = []
    for share in (30, 38, 40, 42, 60):  # percent of 200 words that lie in repeats of seven words, which the base rule doesn't see
        runs = [fresh(7) for _ in range(share * 2 // 14)]
        texts.append([w for r in runs for w in [*r, word()]] + [w for r in runs for w in [*r, word()]])
        texts[-1] += fresh(200 - len(texts[-1]) if len(texts[-1]) < 200 else 0)
    for n in (199, 200, 201, 230):  # one long repeat in a text so long that it covers little
        run = fresh(n)
        texts.append(run + fresh(2_000) + run)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    verdicts = []
    for i, t in enumerate(texts):
        covered, longest = repeats(t, 5)
        fine = 100 * covered <= 40 * len(t) and longest <= 200
        assert (got[i].n_covered_words, got[i].longest_repeat) == (covered, longest)
        assert got[i].kept == (fine and not got[i].base_failed)
        verdicts.append((fine, got[i].base_failed))
    assert {f for f, base in verdicts if not base} == {True, False}


def test_discounts_by_hand():
    """Good-Turing with Katz's correction: d_r = (r*/r - c) / (1 - c), r* = (r + 1) n_(r+1) / n_r, c = (k + 1) n_(k+1) / n_1."""
    n = [10_000, 2_000, 800, 420, 260, 180]
    c = 6 * n[5] / n[0]
    want = [1.0] + [((r + 1) * n[r] / (r * n[r - 1]) - c) / (1 - c) for r in range(1, 6)]
    got = lm_katz.discounts([sum(r * x for r, x in enumerate(n, 1)) + 50_000, sum(n) + 900, *n])
    assert np.allclose(got, want, rtol=1e-12)
    # what discounts take off all counts up to k is what Good-Turing gives to words never seen
    assert math.isclose(sum((1 - got[r]) * r * n[r - 1] for r in range(1, 6)), n[0], rel_tol=1e-9)
    assert Counter(x < 1 for x in got[1:]) == {True: 5}


def test_shards_of_documents_that_have_a_shard_column(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(9).cast("bigint").alias("n_chars"), (F.col("id") * 2).alias("_shard"))
    key = sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert key == "__shard" and {r["doc_id"]: r["_shard"] for r in back.collect()} == {i: 2 * i for i in range(40)}
    assert [r.n for r in back.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()] == [5] * 8
