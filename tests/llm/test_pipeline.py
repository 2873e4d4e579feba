import re
from collections import Counter, defaultdict


import corpus_pipeline
from revlens.llm import quality, stages
from tests.llm.test_linedup import brute as brute_lines
from tests.llm.test_mixing import targets
from tests.llm.test_packing import brute_pieces, check_layout
from tests.llm.test_simhash import brute as brute_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources to target weights", "best-fit packing"]
    out = {}
    for name, apply in corpus_pipeline.STAGES:
        docs = stages.mixing.stage(apply(spark, docs, sf_dir), "test")
        out[name] = docs.collect()
        assert name == "best-fit packing" or docs.columns == columns
    # 1: the same network over the same texts
    net = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = quality.score_texts([texts[i] or "" for i in texts], net, net.tables())
    good = {i for i, s in zip(texts, scores, strict=True) if s >= quality.THRESHOLD}
    assert {r["doc_id"] for r in out["quality classifier"]} == good and 0 < len(good) < len(texts)
    # 2
    lines = [(i, t) for i, t in brute_lines([(i, texts[i]) for i in sorted(good)]) if t.strip() or not texts[i].strip()]
    assert sorted((r["doc_id"], r["text"]) for r in out["line dedup"]) == sorted(lines)
    assert all(r["n_chars"] == len(r["text"]) for r in out["line dedup"])
    # 3
    ones = {i for i, _, c in brute_groups(lines) if i == c}
    assert {r["doc_id"] for r in out["simhash near-dedup"]} == ones
    # 4
    size = {i: len(WORD.findall(t)) for i, t in lines if i in ones}
    sizes, taken = Counter(), Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = targets(sizes)
    times = Counter(r["doc_id"] for r in out["mixing sources to target weights"])
    longest = defaultdict(int)
    for i, n in times.items():
        taken[source[i]] += n * size[i]
        longest[source[i]] = max(longest[source[i]], size[i])
        assert n <= 2
    for s in want:
        assert want[s] - 1 <= taken[s] <= want[s] + longest[s] + 1
    # 5
    mixed = [(r["doc_id"], r["text"]) for r in out["mixing sources to target weights"]]
    rows = out["best-fit packing"]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == brute_pieces(mixed, 4096)
    assert check_layout(rows, 4096) <= 1.02 * -(-sum(r["length"] for r in rows) // 4096) + 1


def test_awkward_rows(spark, awkward, no_documents, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(4, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (awkward.withColumn("n_chars", stages.F.length("text").cast("long")), no_documents):
        columns = docs.columns
        for name, apply in corpus_pipeline.STAGES:
            docs = stages.mixing.stage(apply(spark, docs, folder), "test")
            assert name == "best-fit packing" or docs.columns == columns
        docs.count()


def test_mix_takes_rows_of_null_and_repeated_ids_on_their_own(spark):
    # a is taken twice, b in part, c more than once
    docs = [(None if i % 2 else 7, f"{s}{i} " * (30 + i), s, i) for i in range(40) for s in "abc"]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, n long")
    numbered = frame.withColumn("row", stages.F.concat("source", "n"))
    taken = {r["row"]: r["taken"] for r in stages.mixing.mix(numbered, keep=("row",)).documents.collect()}
    got = Counter(f"{r['source']}{r['n']}" for r in stages.mix_sources(spark, frame, "").collect())
    assert got == Counter({k: -(-v // (30 + int(k[1:]))) for k, v in taken.items() if v})
    assert len(set(got.values())) > 1 and len(got) < len(docs)
