"""Mixing, line templates, toxicity and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernsift.llm import line_templates, mixing, queries, toxicity
from fernsift.llm.words import words_of
from tests.conftest import SMALL


def plain_targets(sizes, weights=(5, 2, 1), total=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = total * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        above = {s for s, x in share.items() if x > most * sizes[s]}
        if not above:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= above


def check_mix(rows, got):
    """rows: (id, text, source); got: rows of the query, by id."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = defaultdict(int)
    for i, _, s in rows:
        of[s] += size[i]
    target, took, largest = plain_targets(of), defaultdict(int), defaultdict(int)
    for i, _, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], of[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken % max(size[i], 1) == 0 and r.taken <= 2 * size[i]
        epochs = math.floor(target[s] / of[s]) if of[s] else 0
        assert not size[i] or r.taken // size[i] in (epochs, epochs + 1)
        took[s] += r.taken
        largest[s] = max(largest[s], size[i])
    for s, words in took.items():
        assert abs(words - target[s]) <= largest[s] / 2 + 1e-6


def test_mix_of_the_table(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    runs = [queries.op3_mixing(spark, SMALL).collect() for _ in range(2)]
    assert sorted(runs[0]) == sorted(runs[1])
    check_mix(rows, {r.doc_id: r for r in runs[0]})


def test_mix_of_uneven_sources(spark):
    rows = [(i, "w " * (i % 17), ["big", "Zed", None, "é", "tiny"][0 if i % 3 else i % 5]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    got = mixing.mix(docs).select("doc_id", "mixed.*").collect()
    check_mix(rows, {r.doc_id: r for r in got})


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "w w w w", "only") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    weight = F.when(F.col("doc_id") % 2 == 0, F.lit(4.0)).otherwise(F.lit(1.0))
    got = mixing.mix(docs, quality=weight).select("doc_id", "mixed.copies").collect()
    taken = Counter((r.doc_id % 2, r.copies) for r in got)
    assert taken[0, 2] > 1.5 * taken[1, 2] and sum(taken.values()) == 2000


def test_mix_without_ids(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * (1 + i % 7), "a" if i % 3 else "b") for i in range(600)], "doc_id LONG, text STRING, source STRING")
    runs = [sorted(map(repr, mixing.mix(docs).select("text", "mixed.*", "source").collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("mixed.taken").alias("taken"), F.max("mixed.target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 7 / 2


def test_mix_edges(spark, edge_docs, no_docs):
    got = mixing.mix(edge_docs, into="score")
    assert got.columns == [*[c for c in edge_docs.columns if c != "score"], "score"]
    assert got.count() == edge_docs.count()
    twins = got.filter("doc_id = 5").select("score.taken").collect()
    assert len(twins) == 2 and twins[0] == twins[1]
    assert mixing.mix(no_docs).count() == 0 and mixing.draw(no_docs).count() == 0
    drawn = mixing.draw(edge_docs)
    assert drawn.columns == edge_docs.columns
    words = edge_docs.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(drawn.select(F.sum(mixing.word_count(F.col("text")))).first()[0] - 1.5 * words) <= 40_000 / 2 + 50  # half of the largest


def test_lines_of_recurring_templates_go(spark):
    notice = "This page number {} was made by the site engine on some day"
    rows = [(i, f"{'x' * i} own words of this text only\n{notice.format(i)}\n\nmore own {'y' * i} words here") for i in range(1, 7)]
    rows += [(20 + i, "copied first line of words\ncopied second line of words\ncopied third line of words") for i in range(6)]
    rows += [(40, f"another opening for this text\n{notice.format(9).replace('some', 'one')}"), (41, "copied first line of words\nand something else that is its own here")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id LONG, text STRING, n_dropped INT")
    got = {r.doc_id: r for r in line_templates.drop_recurring(docs).collect()}
    for i in range(1, 7):
        assert got[i].text == f"{'x' * i} own words of this text only\n\nmore own {'y' * i} words here"
        assert got[i].n_dropped == 1
    assert all(got[20 + i].text == rows[6][1] and got[20 + i].n_dropped == 0 for i in range(6))
    assert got[40].text == "another opening for this text"
    assert got[41].text == rows[13][1]  # copies do not make a line recur


def agree(words, others):
    return 10 * sum(a == b for a, b in zip(words, others, strict=True)) >= 7 * len(words)


@pytest.mark.parametrize("mates", [0, 11, 30, 300])
def test_lines_recur_beside_any_number_of_leaf_mates(spark, mates):
    rng = random.Random(mates)
    made = lambda n: [f"{rng.choice('bcdfgh')}{''.join(rng.choices('aeioulmnrst', k=9))}" for _ in range(n)]
    head = ["all", "lines", "open", "alike"]
    kinds = [made(16) for _ in range(3)]
    recurring = [" ".join(head + kinds[0])] * 10 + [" ".join(head + kinds[1])] * 4
    recurring += [" ".join(head + kinds[2][:i] + made(3) + kinds[2][i + 3 :]) for i in [5] * 6]  # never twice the same line
    recurring += [" ".join([*head, *("9" + w for w in made(12)), f"end{'x'}", *kinds[0][:3]]) for _ in range(5)]  # mostly fields
    recurring += [" ".join(head + kinds[0][:14] + made(2))]  # one variant
    lines = recurring + [" ".join(head + made(16)) for _ in range(mates)]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, f"{' '.join(made(60))}\n{x}") for i, x in enumerate(lines)], "doc_id LONG, text STRING")
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(docs).collect()}
    masked = [["<*>" if re.search("[0-9]", w) else w for w in x.split()] for x in lines]
    for i, words in enumerate(masked):
        assert got[i] == (sum(agree(words, x) for x in masked) >= 4 or lines[i] in recurring), lines[i]


@pytest.mark.parametrize("copies", [2, 3])
def test_passages_of_many_words_recur_from_two_documents(spark, copies):
    rng = random.Random(copies)
    made = lambda n: " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(n))
    passage, short = made(52), made(20)
    edited = " ".join(w if i % 9 or i < 5 else "other" for i, w in enumerate(passage.split()))
    texts = [[made(70), passage, short, made(40)] for _ in range(copies)] + [[passage[:-1] + " " + made(3), made(90)]] + [[made(70), edited]] * (copies < 3)
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id LONG, text STRING")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(docs).collect()}
    for i in range(copies):
        assert got[i].split("\n") == [texts[i][0], short, texts[i][3]]
    assert got[copies] == "\n".join(texts[copies])
    assert copies == 3 or got[copies + 1] == texts[copies + 1][0]


def test_only_documents_like_one_other_are_copies(spark):
    rng = random.Random(3)
    made = lambda n: " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(n))
    shared = [made(30) for _ in range(12)]
    texts = {i: [shared[i], shared[(i + 1) % 12], shared[(i + 3) % 12], shared[(i + 7) % 12], made(12)] for i in range(12)}  # 91 % in recurring lines
    original = [made(20) for _ in range(10)]
    for k in range(6):  # near copies, each with one other line changed, which hold a line that recurs elsewhere as well
        texts[20 + k] = [*original[:k], made(20), *original[k + 1 :], shared[0]]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id LONG, text STRING")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(docs).collect()}
    for i, lines in texts.items():
        assert got[i] == "\n".join(lines[-1:] if i < 20 else lines[:-1])


def test_templates_are_voted_for_only_where_no_line_leads(spark, monkeypatch):
    """Lines in half of the documents or more, pairs and votes, against the plain rule; the words of few templates are counted."""
    rng = random.Random(5)
    groups = {}
    for leaf in range(150):
        base = rng.choices("abcdef", k=10)
        lines = {tuple(rng.choice("abcdef") if rng.random() < 0.35 else w for w in base): rng.choice([1, 1, 1, 2, 5]) for _ in range(1 + leaf % 5)}
        groups[leaf] = (2 + leaf % 3, lines)
    rows = [(leaf, i, need, docs, " ".join(words), [7]) for leaf, (need, lines) in groups.items() for i, (words, docs) in enumerate(lines.items())]
    equal = spark.createDataFrame(rows, "leaf LONG, same LONG, need INT, docs LONG, words STRING, parts ARRAY<LONG>")
    vote, voted = line_templates._voted, set()
    monkeypatch.setattr(line_templates, "_voted", lambda lines: voted.update(r.leaf for r in lines.select("leaf").collect()) or vote(lines))
    got = line_templates._instances(equal).collect()
    wanted, open_ = set(), set()
    for leaf, (need, lines) in groups.items():
        total = sum(lines.values())
        if total < max(need, 2):
            continue
        fixed = []
        for i in range(10):
            count = Counter()
            for words, docs in lines.items():
                count[words[i]] += docs
            docs, word = max((d, w) for w, d in count.items())
            fixed.append(word if 2 * docs >= total else None)
        wanted |= {(leaf, k) for k, words in enumerate(lines) if agree(words, fixed)}
        if len(lines) > 2 and 2 * max(lines.values()) <= total:
            open_.add(leaf)
    assert len(got) == len(wanted) and {(r.leaf, r.same) for r in got} == wanted
    assert len({r.template for r in got}) == len({leaf for leaf, _ in wanted})
    assert voted == open_ and 10 < len(open_) < 75


def test_line_edges(spark, edge_docs, no_docs):
    got = line_templates.drop_recurring(edge_docs, into="kept")
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(map(str, (r.text for r in edge_docs.collect())))
    assert line_templates.drop_recurring(no_docs).count() == 0


def test_recurring_lines_of_awkward_rows(spark):
    """Null and repeated keys, repeated rows, odd blanks and clashing columns; short lines recur in eight documents only."""
    line = "shared notice of the site with number {}"
    rows = [(None if i % 2 else 1, f"own text {'z' * i} of document\n {line.format(i)}\t \n\nend" + "!" * i) for i in range(5)]
    rows += [rows[0], rows[1], (9, None), (9, "")] + [(20 + i, f"{'q' * (i + 1)} w w w\nok\n" + ("yes" if i < 7 else "")) for i in range(8)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id LONG, text STRING, body INT, place INT, leaf INT, n_dropped STRING")
    got = line_templates.drop_recurring(docs)
    assert got.columns == [*[c for c in docs.columns if c != "n_dropped"], "n_dropped"]
    wanted = [(k, None if t is None else "\n".join(x for x in t.split("\n") if "notice" not in x and x != "ok")) for k, t in rows]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(wanted)


def test_lines_use_no_python(spark):
    plan = queries.op5_line_templates(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_neighbours(vectors, query, k):
    """Every example's cosine by plain sums; all at least as near as the k-th."""
    cosines = {e: sum(w * v.get(t, 0.0) for t, w in query.items()) for e, v in enumerate(vectors)}
    near = sorted((-c, e) for e, c in cosines.items() if c > 1e-15)
    if not near:
        return {}
    least = -near[min(k, len(near)) - 1][0]
    return {e: -c for c, e in near if -c >= least - 1e-12}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    terms = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64))
    idf = rng.uniform(0.5, 4, 60)
    examples = [(i, int(rng.integers(2)), {int(t): int(rng.integers(1, 5)) for t in rng.choice(60, rng.integers(0, 7), replace=False)}) for i in range(700)]
    index = toxicity._lay_out(terms, idf, examples)
    rows: list[dict] = [{} for _ in index.ids]
    for t in range(60):
        for p in range(index.cut[t, 0], index.cut[t, -1]):
            rows[index.example[p]][t] = index.weight[p]
    counts = {i: c for i, _, c in examples}
    for e, i in enumerate(index.ids):  # the layout holds the unit vectors of the right examples
        plain = {t: (1 + math.log(n)) * idf[t] for t, n in counts[i].items()}
        length = math.sqrt(sum(w * w for w in plain.values()))
        assert rows[e] == pytest.approx({t: w / length for t, w in plain.items()})
    for _ in range(200):
        chosen = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        at, w = index.vector(terms[chosen], rng.integers(1, 4, len(chosen)))
        which, cosines = index.neighbours(at, w, 15)
        assert dict(zip(which.tolist(), cosines.tolist(), strict=True)) == pytest.approx(brute_neighbours(rows, dict(zip(at.tolist(), w.tolist(), strict=True)), 15))


def test_document_frequencies_cover_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    texts = [r.text or "" for r in docs.collect()]
    words = words_of(pa.array(["the und de idiot"]), lower=True, letters=True).hashes
    order = np.argsort(words)
    n, df = toxicity._document_frequencies(docs, words[order])
    assert n == len(texts)
    plain = [sum(w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) for t in texts) for w in ("the", "und", "de", "idiot")]
    assert df.tolist() == [plain[i] for i in order]


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[i], got[i].predicted) for i in labels if i in got and got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id LONG, toxic INT")
    index = toxicity.fit(edge_docs, labels)
    got = toxicity.score(edge_docs, index).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_clean(edge_docs, index)
    assert kept.columns == edge_docs.columns
    assert toxicity.score(no_docs, index).count() == 0 and toxicity.keep_clean(no_docs, index).count() == 0
    nothing = toxicity.fit(no_docs, labels.limit(0))
    assert len({r.score for r in toxicity.score(edge_docs, nothing).collect()}) == 1


def test_labels_of_held_out_rows_have_no_bearing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.fit(docs, x.filter(~toxicity.held_out()))).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.store(stage(spark, seen[-1], SMALL), "stage"))
    assert all(x.columns == columns for x in seen[:-1])
    clean, lines, alone, mix, ids = seen[1:]
    index = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet").filter(~toxicity.held_out()))
    toxic = {r.doc_id for r in toxicity.score(docs, index).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    assert lines.count() == clean.count()
    texts = {r.doc_id: r.text for r in alone.collect()}
    assert {r.doc_id for r in mix.collect()} <= set(texts) and ids.count() == mix.count()
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := re.findall(r"[^\x20\x09-\x0D]+", t.lower()))}
    for i in sets:
        for j in sets:
            assert i >= j or 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])


def test_pipeline_edges(spark, no_docs):
    docs = no_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
