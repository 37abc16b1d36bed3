"""Operators of the training-text folder against brute force, SQL and edge cases."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from phrasegraph.llm import (
    decontaminate,
    exact,
    language,
    lines,
    minhash,
    mixing,
    sharding,
    suffixes,
    toxicity,
    urls,
)
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, _id string, _t int"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, lang, "s", 1, "x", 2, "y", 3) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, None, "en"),
    (2, "", None),
    (3, "one", "en"),
    (4, "one", "en"),
    (4, "one", "en"),
    (None, "no id here at all", "de"),
    (None, None, None),
    (5, " \t\n\x0b ", "fr"),
    (6, "Ünïcödé \U0001f600 straße " * 3, "de"),
    (7, "long words of text " * 4000, "en"),
    (8, "x" * 70_000, "en"),
]


@needs_data
@pytest.mark.parametrize("name", ["op1_mixing", "op3_minhash", "op4_line_dedup", "op5_exact_dedup", "op7_url_filters", "op10_sharding"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_and_empty_documents(spark, rows):
    docs = documents(spark, rows)
    n = len(rows)
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert exact.exact_duplicates(docs).count() == n
    assert lines.drop_repeated_lines(docs).count() == n
    assert minhash.near_duplicates(docs).count() == n
    assert suffixes.drop_repeats(docs).count() == n
    assert toxicity.learn_and_score(docs, labels).count() == n
    assert language.learn_and_predict(docs).count() == n
    assert mixing.mix(docs).count() == n
    placed = sharding.assign_shards(docs, 3).collect()
    assert sorted(r["position"] for r in placed) == list(range(n))
    assert decontaminate.find_leaks(docs, none).count() == 0
    found = minhash.near_duplicates(docs).filter("doc_id = 2").collect()
    assert [(r["n_shingles"], r["kept"]) for r in found] == ([(0, True)] if rows else [])


def test_lines_count_ids_not_rows(spark):
    """A line in three rows of two ids stays; null ids are documents of their own; the largest id keeps the line."""
    two, three, nulls = "a line that two ids hold", "a line that three ids hold", "a line of rows without an id"
    rows = [
        (1, f"{two}\n{three}", "en"),
        (1, f"{two}\n{three}", "en"),
        (2, f"{two}\n{three}\n{nulls}", "en"),
        (3, f"{three}", "en"),
        (None, nulls, "en"),
        (None, nulls, "en"),
    ]
    got = lines.drop_repeated_lines(documents(spark, rows)).collect()
    kept = sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in got)
    assert kept == [(0, "", 1), (0, "", 1), (1, two, 1), (1, two, 1), (2, f"{two}\n{nulls}", 1), (3, three, 0)]


def test_exact_digest_paths_agree(spark):
    rows = [(i, random.Random(i % 7).choice(["a  b", "a b", "ab ", "c", None]), "en") for i in range(40)]
    docs = documents(spark, rows)
    want = {}
    for i, t, _ in rows:
        want.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(docs).collect()}
    for ids in want.values():
        for i in ids:
            assert got[i] == (min(ids), len(ids), i == min(ids))


def test_suffix_array():
    draw = random.Random(3)
    for _ in range(1500):
        x = [draw.randrange(1, draw.choice([2, 3, 5, 30])) for _ in range(draw.randrange(60))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def cut(texts):
    """Brute force: bytes covered by a repeated string of 200 bytes."""
    seen = Counter(b[i : i + 200] for b in texts.values() for i in range(len(b) - 199))
    out = {}
    for k, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(v for v, g in zip(b, gone, strict=True) if not g)
        out[k] = (len(b), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize("group", [4000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    draw = random.Random(5)
    letters = "abcdé "
    passages = ["".join(draw.choices(letters, k=k)) for k in (150, 198, 199, 200, 201, 260, 400, 900)]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            part = draw.choice(passages)
            if draw.random() < 0.5:
                at = draw.randrange(len(part))
                part = part[:at] + draw.choice(letters) + part[at + 1 :]
            parts += ["".join(draw.choices(letters, k=draw.randrange(60))), part]
        texts[i] = "".join(parts)
    texts[60], texts[61] = "a" * 500, "ab" * 101
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.drop_repeats(docs).collect()}
    assert got == cut({k: t.encode() for k, t in texts.items()})


@needs_data
def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = cut({r[0]: (r[1] or "").encode() for r in docs})
    for r in entry.queries()["op8_suffix_dedup"](spark, SF).collect():
        size, removed, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            size, removed, spans, hashlib.sha256(kept).hexdigest())


def test_near_duplicates_in_one_large_group(spark):
    """Edited copies of one text, with and without the original: links equal those of all pairs."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    texts = {0: " ".join(words)}
    for i in range(1, 150):
        row = list(words)
        for _ in range(draw.randrange(1, 8)):
            row[draw.randrange(120)] = f"n{draw.randrange(10**6)}"
        texts[i] = " ".join(row)
    for drop in (None, 0):
        some = {k: t for k, t in texts.items() if k != drop}
        sets = {k: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for k, t in some.items()}
        root = {k: k for k in some}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a in some:
            for b in some:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
        assert got == {k: find(k) for k in some}


def test_tables_reach_recall():
    t = minhash.Tensor.reaching(0.8, 0.99999)
    assert (1 - (1 - 0.8**t.width) ** t.rows) ** 2 >= 0.99999


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    assert sorted(sharding.permute(i, n, 42) for i in range(n)) == list(range(n))
    got = spark.range(n).select("id", sharding.feistel(F.col("id"), n, 42).alias("p"))
    assert {r["id"]: r["p"] for r in got.collect()} == {i: sharding.permute(i, n, 42) for i in range(n)}


@needs_data
def test_sharding_is_native(spark):
    plan = entry.queries()["op10_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_url_rules(spark):
    pages = [(1, "http://A.Example.NET/en/x?q"), (2, "https://b.net"), (3, "https://b.net/"), (4, None), (5, "no scheme"),
             (6, "http://x.org/fr/"), (7, "http://notnet/de/"), (8, "http://www.example.com/de/1#t"), (8, "http://www.example.com/de/1#t")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.rule_table(spark, rules)).fillna("", ["rule"]).collect())
    assert got == [(1, "example.net/en/", "allow"), (2, "", "allow"), (3, "net/", "block"), (4, "", "allow"), (5, "", "allow"),
                   (6, "org/fr/", "allow"), (7, "", "allow"), (8, "example.com/de/", "block"), (8, "example.com/de/", "block")]
    assert urls.judge_urls(df, urls.rule_table(spark, [])).filter("verdict = 'block'").count() == 0


def test_grammar():
    model = toxicity.Model()

    def kinds(text):
        return {toxicity.NAMES[i] for i in np.flatnonzero(model.features(text))}

    assert kinds("You are an idiot.") == {("insult", True, False)}
    assert kinds("The idiot left.") == {("insult", False, False)}
    assert kinds("You are not an idiot.") == set()
    assert kinds('He said "idiot".') == {("insult", True, True)} or kinds('Anna said "idiot".') == {("insult", False, True)}
    assert kinds("I will kill you. Fine") == {("threat", False, False)}
    assert kinds("idiots and scummy things") == set()


THREATENING = ["I will kill you. Fine", "we are going to hurt all of you", "ich werde dich töten", "they want to shoot him today"]
HARMLESS = ["I will not kill you", "the frost can kill tomatoes", 'Anna wrote "I will kill you"', "the report is long"]


def test_directed_threats_are_found(spark):
    rows = [(i, "you are an idiot" if i % 9 == 0 else f"plain text {i}") for i in range(900)]
    extra = list(enumerate(THREATENING + HARMLESS, 10_000))
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert [scores[i] >= 0.3 for i, _ in extra] == [True] * len(THREATENING) + [False] * len(HARMLESS)
    bare = toxicity.Model()
    assert [bare.probability(bare.matches(t)) >= 0.3 for t in THREATENING + HARMLESS] == [True] * 4 + [False] * 4


def test_rare_insults_and_inflected_forms(spark):
    words = [f"gr{a}m{b}p" for a in "aeiou" for b in "aeiou"]
    rows = [(i, f"du bist ein {words[i % 25]} {i}" if i % 8 == 0 else f"du bist ein gast {i}") for i in range(2000)]
    extra = [(5000, "the gramups left"), (5001, "those two idiots"), (5002, "estúpidas"), (5003, "two tables")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    # Every word is in 4 % of the toxic rows.
    assert set(words) <= set(model.insults) and not {"du", "bist", "ein", "gast"} & set(model.insults)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert [scores[i] >= 0.3 for i in range(5000, 5004)] == [True, True, True, False]


@needs_data
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = entry.queries()["op2_language_id"](spark, sf).filter("held_out").join(docs, "doc_id")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = entry.queries()["op6_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id")
    hits = judged.filter("predicted = 1")
    assert hits.count() and hits.filter("toxic = 1").count() >= 0.8 * hits.count()


@needs_data
def test_held_out_toxic_rows_are_found(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = entry.queries()["op6_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id")
    toxic = judged.filter("toxic = 1")
    assert toxic.filter("predicted = 1").count() >= 0.8 * toxic.count()


def test_no_gram_is_dropped(spark):
    draw = random.Random(4)
    rows = [(i, "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(2300)), "zh") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = np.unique(np.concatenate([language.grams(language.symbols(t)) for _, t, _ in rows]))
    model = language.fit(docs)
    assert len(want) > 200_000 and np.array_equal(model.codes[0], want)


def test_kneser_ney_sums_to_one():
    codes, n = np.unique(np.concatenate([language.grams(language.symbols(t)) for t in ("abab abc", "cab cab")]), return_counts=True)
    model = language.build({"xx": (codes, n)})
    history = codes[0] >> np.uint64(16)
    symbols = np.unique(codes & np.uint64(0xFFFF))
    p = np.exp(model.position_logs((history << np.uint64(16)) | symbols)).sum()
    assert 0.7 < p <= 1.0001  # the rest belongs to unseen characters


def test_leaks(spark):
    draw = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(12, 50)))) for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        body = draw.choices(vocabulary, k=draw.randrange(200))
        if d % 2:
            i, text = draw.choice(items)
            words = text.split()
            for _ in range(draw.randrange(int(0.15 * len(words)) + 1)):
                at = draw.randrange(len(words))
                words[at : at + 1] = draw.choice([["new"], [], [words[at], "more"]])
            at = draw.randrange(len(body) + 1)
            body[at:at] = words
            want.add((d, i))
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    brute = {
        (d, i)
        for d, t in docs
        for i, x in items
        if decontaminate.best_match(x.split(), t.split())[0] <= max(1, int(0.15 * len(x.split())))
    }
    assert want <= brute
    for block in (1 << 20, 600):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, block_bytes=block).collect()}
        assert got <= brute and len(got) >= 0.99 * len(brute)


def test_raking_meets_margins(spark):
    rows = [(i, "w " * (i % 9 + 1), ["en", "de"][i % 3 == 0], ["a", "b", "c"][min(i % 7, 2)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5)], "value string, target double")
    mixed = mixing.mix(docs, targets={"source": want}).toPandas()
    share = (mixed.mix_tokens * mixed.mix_weight).groupby(mixed.mix_source).sum()
    assert np.allclose(share / share.sum(), [0.2, 0.3, 0.5], atol=1e-6)
    assert mixed.mix_probability.max() <= 1 and 0 < mixed.mix_sampled.sum() <= len(mixed)


def test_rare_source_does_not_thin_the_rest(spark):
    rows = [(i, "w " * (i % 9 + 1), "en", ["hot", "b", "c"][min(i % 7, 2) if i % 3 else 0]) for i in range(3000)]
    rows.append((9999, "w " * 30, "en", "tiny"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs).toPandas()
    tokens = mixed.mix_tokens.sum()
    assert np.isclose((mixed.mix_tokens * mixed.mix_probability).sum(), 0.5 * tokens)
    assert 0.4 * tokens < mixed.mix_tokens[mixed.mix_sampled].sum() < 0.6 * tokens
    # Plain Python: halve the interval that holds c.
    lo, hi = 0.0, 1e6
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if (mixed.mix_tokens * np.minimum(1, c * mixed.mix_weight)).sum() < 0.5 * tokens else (lo, c)
    assert np.allclose(mixed.mix_probability, np.minimum(1, lo * mixed.mix_weight))
    tiny = mixed[mixed.mix_source == "tiny"].iloc[0]
    want = 0.5 * tokens * tiny.mix_weight / (mixed.mix_tokens * mixed.mix_weight).sum()
    assert tiny.mix_probability == 1 and np.isclose(tiny.mix_missed, 1 - 1 / want) and tiny.mix_missed > 0.5
    assert mixing.mix(docs, retention=1.0).filter("mix_sampled").count() == len(rows)


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        ids = left
    final = entry.queries()["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in final} == ids
    assert sorted(r["position"] for r in final) == list(range(len(ids)))


def test_language_limits_come_from_all_rows(spark):
    """More rows than any sample of old: sharpness and limits are those of the whole training table."""
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("abcde" if i % 2 else "defgh"), 12)), "x" if i % 2 else "y") for i in range(10_400)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    e = np.array([model.entropies(t)[0] for _, t, _ in rows])
    truth = np.array([model.langs.index(k) for *_, k in rows])
    right = e.argmin(axis=1) == truth
    for k, lang in enumerate(model.langs):
        assert model.limits[lang] == pytest.approx(np.quantile(e[right & (truth == k), k], 0.995), abs=1e-12)
    losses = []
    for s in 2.0 ** np.arange(0, 8, 0.5):
        odds = np.exp((e.min(axis=1, keepdims=True) - e) * s)
        losses.append((-np.log((odds / odds.sum(axis=1, keepdims=True))[np.arange(len(e)), truth] + 1e-9).mean(), s))
    assert model.sharpness == min(losses)[1]
