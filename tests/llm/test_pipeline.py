"""The pipeline on a small corpus with planted cases, and its stages against what they should keep."""

import random
from collections import Counter

import corpus_pipeline
from gaugewright.llm.pieces import vocabulary
from gaugewright.llm.pii import base_spans


def test_planted_cases(spark, tmp_path):
    rng = random.Random(6)
    plain = ["".join(rng.choice(["an", "er", "ti", "ou", "th", "re", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    docs = [(i, text(rng.choice([30, 80, 200]))) for i in range(300)]
    toxic = list(range(0, 60))
    docs = [(i, f"{t} {rng.choice(['zorked', 'blixing', 'zorkal'])} blixous {text(3)}") if i in toxic else (i, t) for i, t in docs]
    item = text(25)
    docs += [(400 + i, docs[100][1]) for i in range(5)]  # exact copies of 100
    base = docs[101][1].split() + text(100).split()
    docs[101] = (101, " ".join(base))
    docs += [(410 + i, " ".join([*base[:40], f"edit{i}", *base[41:]])) for i in range(5)]  # near copies of 101
    docs += [(420, f"{text(20)} {item} {text(20)}"), (421, f"{text(20)} {' '.join(item.split()[:9])} {text(20)}")]
    docs += [(430, f"{text(10)} write to someone@mail.example or +49 30 1234567 now"), (440, None), (441, ""), (None, text(50)), (450, docs[102][1]), (450, docs[102][1]), (451, text(60)), (451, text(60)), (-9, text(40)), (-9, docs[103][1])]
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    columns = kept.columns
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder).cache()
        ids[name] = {r["doc_id"] for r in kept.collect()}
        if name == "ngram_jaccard_join":
            kept_rows = Counter(r["doc_id"] for r in kept.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
        if name == "pii":
            cleaned = kept.collect()
            clean = {r["doc_id"]: r for r in cleaned}
    every = {d for d, _ in docs}
    assert len(ids["toxicity"] & set(toxic)) <= 2 and len(every - set(toxic) - ids["toxicity"]) <= 2
    gone = ids["toxicity"] - ids["ngram_jaccard_join"]
    assert gone >= (set(range(400, 405)) | set(range(410, 415))) and {100, 101} & ids["toxicity"] <= ids["ngram_jaccard_join"]
    assert gone <= set(range(400, 405)) | set(range(410, 415)) | {102, 103, 450} and len(gone & {102, 450}) == 1 == len(gone & {103}) and kept_rows[451] == 2 == kept_rows[-9]
    assert ids["ngram_jaccard_join"] - ids["decontamination"] == {420}
    assert not base_spans(clean[430]["text"]) and clean[430]["n_chars"] == len(clean[430]["text"])
    words = vocabulary(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    final = kept.collect()
    assert sorted(words.decode(bytes(r["ids"])) for r in final) == sorted(r["text"] or "" for r in cleaned)
    assert corpus_pipeline.run(spark, folder).count() == len(final)
