import hashlib
import re
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from kinweave.llm import quality, secret_scan
from kinweave.sources import staging
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r.doc_id for r in quality.grade(docs, model).where("kept").collect()}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    first = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in rows], 5, Fraction(4, 5)) if k}
    rows = [r for r in rows if r.doc_id in first]
    assert 0 < len(rows) < docs.count()

    order = {r.kind: i for i, r in enumerate(secret_scan.RULES)}
    clean = []
    for r in rows:
        found = [(m.start(), x.kind, m.end()) for x in secret_scan.RULES for m in re.compile(x.pattern, re.ASCII).finditer(r.text) if len(m[x.group]) >= x.least]
        out, at = "", 0
        for a, kind, b in sorted(found, key=lambda s: (s[0], order[s[1]])):
            if a >= at:
                out += r.text[at:a] + f"[{kind}]"
            at = max(at, b)
        clean.append((r.doc_id, out + r.text[at:], r.source, r.lang))

    sizes: dict = {}
    for _, t, s, _ in clean:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    from tests.llm.test_mixing import water

    target = water(sizes)
    want = {}
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    for i, t, s, lang in clean:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        key = md5(":".join("" if x is None else md5(x) for x in (i, lang, len(t), s, t)))
        draw = int(md5(f"17:{key}:0")[:13], 16) / 16**13
        n = int(rate) + (draw < rate - int(rate))
        if n:
            want[i] = (n, len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    got = P.run(spark, SF).collect()
    words: dict = {}
    for r in got:
        words.setdefault((r.doc_id, r.copy), 0)
        words[r.doc_id, r.copy] += r.n_words
    assert words == {(i, c): size for i, (n, size) in want.items() for c in range(n)}
    ends: dict = {}
    for r in got:
        ends[r.bin_id] = max(ends.get(r.bin_id, 0), r.bin_offset + r.n_words)
    assert max(ends.values()) <= 2048


def test_stages_return_the_columns_of_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == P.COLUMNS
        assert P.STAGES[-1][1](spark, docs, SF).count() >= 0


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = quality.grades_of(spark.read.parquet(f"{sf}/labels.parquet"))
    kept = P.keep_good(spark, docs, sf).select("doc_id").withColumn("k", F.lit(1))
    got = {r.grade: r.share for r in labels.join(kept, "doc_id", "left").groupBy("grade").agg(F.avg(F.coalesce("k", F.lit(0))).alias("share")).collect()}
    assert got[2] > 0.95 and got[0] < 0.1


def test_mark_is_a_word_less_change(spark):
    frame = spark.createDataFrame([(1, "token=abcdefgh end", "en", "a", 18)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.hide_secrets(spark, frame, SF).first()
    assert got.text == "[assign] end" and got.n_chars == len(got.text)


def test_odd_rows_of_each_stage(spark, odd_docs, no_docs):
    """What the stages' docstrings say of null, empty and very long texts, ties and repeated rows."""
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 6")).unionByName(odd_docs.where("doc_id = 9").withColumn("text", F.concat("text", F.lit("a " * 300_000))).withColumn("doc_id", F.lit(90).cast("long")))
    rows = {n: sorted(tuple(r) for r in docs.select([F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in P.COLUMNS]).collect()) for n in "x"}["x"]
    kept = P.keep_good(spark, docs, SF)
    assert kept.where("text is null or trim(text) = ''").count() == 0
    near = P.drop_near_duplicates(spark, docs, SF)
    ids = sorted(r.doc_id for r in near.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 90] and near.where("doc_id is null").count() == 1
    clean = {r.doc_id: r for r in P.hide_secrets(spark, docs, SF).collect()}
    assert clean[3].text is None and clean[3].n_chars is None and clean[4].text == "" and clean[8].text == "日本語のテキスト [assign] and [access]" and clean[8].n_chars == len(clean[8].text)
    assert clean[90].n_chars == 15000 + 600_000
    mixed = P.mix_sources(spark, docs, SF)
    own = {r[0]: r for r in rows}
    assert {r[0] for r in mixed.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).collect()} <= set(own)
    packed = P.pack_bins(spark, docs, SF).collect()
    assert sum(r.n_words for r in packed if r.doc_id == 90) == 303_000 and sorted({(r.doc_id, r.copy) for r in packed if r.doc_id in (2, 6)}) == [(2, 0), (2, 1), (6, 0), (6, 1)]


def test_one_row_of_each_kept_id(spark):
    rows = [(5, "some words of one text here", "en", "a", 1)] * 40 + [(5, "some words of one text here", "fr", "a", 1), (7, "Some words of one text here", "en", "b", 2), (8, "others", "en", "b", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one, two = (sorted(tuple(r) for r in P.drop_near_duplicates(spark, f, SF).collect()) for f in (frame, frame.orderBy(F.desc("lang"))))
    assert one == two and [r[0] for r in one] == [5, 8]


def test_staged_inputs_are_dropped(spark):
    before = staging.roots()
    P.run(spark, SF).count()
    left = [p for root in staging.roots() - before for p in Path(root).glob("*") if p.is_dir()]
    # the packing's input and what packing itself staged
    assert len(left) <= 5
