import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline
from lakeloom.llm import queries, stages
from tests.llm import brute
from tests.compare import assert_same, connect

COLUMNS = {
    "op1": {"page_id", "url", "text", "n_chars"},
    "op3": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op7": {"doc_id", "held_out", "score", "predicted"},
    "op9": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op11": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op13": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op10": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def test_repeated_passages_go_and_other_texts_stay(spark):
    """Documents with 51 words in a row of an earlier one lose some text; those that share no such run with any other keep theirs."""
    sf_dir = "/root/testdata/sf0.01"
    texts = {r[0]: brute.words(r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    first, later, shared = {}, set(), set()
    for i in sorted(texts):
        for k in range(len(texts[i]) - 50):
            o = first.setdefault(tuple(texts[i][k : k + 51]), i)
            if o != i:
                later.add(i)
                shared |= {i, o}
    clean = {i for i, w in texts.items() if w} - shared
    got = {r["doc_id"]: r["n_removed"] > 0 for r in queries.op6_substring_dedup(spark, sf_dir).collect()}
    assert sum(got[i] for i in later) >= 0.9 * len(later) > 50
    assert sum(not got[i] for i in clean) >= 0.9 * len(clean) > 500


def test_lines_of_any_length_go_in_the_query_and_the_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, later = set(), set()
    for i, t in sorted((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()):
        for k, line in enumerate(t.split("\n")):
            words = frozenset(brute.words(line))
            later |= {(i, k)} if 0 < len(words) < 4 and words in seen else set()
            seen.add(words)
    got = {r["doc_id"]: {int(k) for k in r["removed_lines"].split(",") if k} for r in queries.op2_line_dedup(spark, sf_dir).collect()}
    assert later and all(k in got[i] for i, k in later)
    texts = [r["text"] for r in stages.drop_lines(spark, docs, sf_dir).collect()]
    short = [w for t in texts for line in t.split("\n") if 0 < len(w := frozenset(brute.words(line))) < 4]
    assert len(short) == len(set(short))


def test_queries_return_their_columns_for_every_row(spark, sf_dir):
    found = queries.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in found)] == []
    for name, f in found.items():
        if columns := COLUMNS.get(name.split("_")[0]):
            df = f(spark, sf_dir)
            assert columns <= set(df.columns)
            table = "pages" if name.startswith("op1_") else "documents"
            key = "page_id" if table == "pages" else "doc_id"
            assert df.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_corpus_run_equals_brute_force(spark, sf_dir):
    """All stages by plain code, but for the fitted scores, which are the classifier's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).select("doc_id", "text").collect()
    later = brute.later_lines([(r[0], r[1]) for r in good], least=1)
    texts = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in later[r[0]]) for r in good}
    texts = {i: t for i, t in texts.items() if not later[i] or brute.words(t)}
    linked = brute.components(list(texts.items()))
    texts = {i: t for i, t in texts.items() if linked[i][1] == i}
    items = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    texts = {i: t for i, t in texts.items() if not any(brute.covered(t, x) for x in items)}
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(encode.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == want
    assert sum(r["length"] for r in rows) == sum(want.values())


def test_corpus_stages_pass_documents_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_corpus_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, sf_dir):
    """Every stage over rows of every special case: a defined result, the same columns, nothing lost that it should keep."""
    line = "these are plain words of an ordinary line that says a little about something."
    prose = " ".join(f"word{k % 97} and{k % 89} then{k % 83}." for k in range(120))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, f"{line}\n{prose}"), (5, f"{line}\n{prose} tail"), (6, prose), (6, prose), (None, prose), (None, None), (7, "x " * 60_000), (8, f"{line}\nsomething of its own that no other text has in it")]
    extra = "n_removed int, kept boolean, row string, gone int, id long, kept_text string, class int"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, True, "r", 2, 3, "k", 4) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for given in (df, df.limit(0)):
        before = given.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, sf_dir)
            assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
            got = out.collect()
            assert len(got) <= before and all(r["kept_text"] == "k" and r["n_removed"] == 1 for r in got), name
        packed = corpus_pipeline.STAGES[-1][1](spark, given, sf_dir)
        assert packed.agg({"length": "sum"}).first()[0] == (packed.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0])
    ids = lambda out: sorted((r["doc_id"] for r in out.collect()), key=str)
    _, lines, near, clean, _ = (stage for _, stage in corpus_pipeline.STAGES)
    kept = {(r["doc_id"], r["text"]) for r in lines(spark, df, sf_dir).collect()}
    assert (5, f"{prose} tail") in kept or (5, prose) not in kept
    assert {(1, None), (2, ""), (None, prose), (None, None)} <= kept and (8, "something of its own that no other text has in it") in kept
    assert ids(near(spark, df, sf_dir)) == sorted([1, 2, 3, 4, 7, 8, None, None], key=str)
    assert ids(clean(spark, df, sf_dir)) == sorted((i for i, _ in rows), key=str)
