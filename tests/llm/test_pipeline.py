import random

import corpus_pipeline
from test_packing import check as check_packing
from test_pii import plain_spans

from wavequarry.llm.quality import train_quality
from wavequarry.llm.suffix_dedup import PASSAGE


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, text(rng.randrange(40, 160))) for k in range(60)]
    docs += [(100 + k, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text(60).split())) for k in range(40)]
    near = docs[3][1].split()
    near[7] = "changed"
    docs += [(200, docs[0][1]), (201, " ".join(near)), (202, "too short"), (203, None)]
    passage = text(90)
    docs += [(210 + k, f"{text(30)} {passage} {text(20)}") for k in range(3)]
    docs += [(220, f"{text(30)} write to someone@mail.com or +1 555 123 4567 {text(30)}")]
    # passages of 51 to 59 words, and stretches of 239 and 240 bytes between unlike letters
    short = [" ".join("".join(rng) for rng in (rnd_word(rng_, 4, 6) for _ in range(n))) for n, rng_ in ((51, random.Random(7)), (59, random.Random(8)))]
    edges = ["".join(random.Random(9 + n).choices("bcdfghjm", k=n)) for n in (239, 240)]
    for k, own in enumerate(short):
        docs += [(230 + 2 * k + j, f"{text(30)} {own} {text(25)}") for j in range(2)]
    for k, own in enumerate(edges):
        docs += [(240 + 2 * k + j, f"{text(40)} {c}{own}{c} {text(35)}") for j, c in enumerate("qk")]
    labels = [(k, int(k < 100), 0) for k, _ in docs if k < 140]
    return docs, labels, passage, short, edges


def rnd_word(rng, least, most):
    return rng.choices("aeioulnrst", k=rng.randint(least, most))


def test_run_against_plain_code(spark, tmp_path):
    docs, labels, passage, short, edges = corpus(1)
    full = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in docs]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages, kept = {}, table
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        kept = stages[name] = spark.read.parquet(str(tmp_path / name))
    texts = dict(docs)
    got = {n: {r["doc_id"]: r["text"] for r in s.collect()} for n, s in stages.items() if "text" in s.columns}
    assert all(s.columns == table.columns for n, s in stages.items() if n != "packed_sequences")

    model = train_quality(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {k for k, t in docs if len((t or "").split()) >= 10 and model.probability(t) >= 0.5}
    assert set(got["quality_rules"]) == good and good.isdisjoint(range(100, 140)) and set(range(60)) <= good
    assert set(got["near_duplicates"]) == good - {200, 201}

    seen = {}
    for k, t in got["near_duplicates"].items():
        raw = t.encode()
        for a in range(len(raw) - PASSAGE + 1):
            seen[raw[a:a + PASSAGE]] = seen.get(raw[a:a + PASSAGE], 0) + 1
    for k, t in got["near_duplicates"].items():
        raw = t.encode()
        gone = set()
        for a in range(len(raw) - PASSAGE + 1):
            if seen[raw[a:a + PASSAGE]] > 1:
                gone.update(range(a, a + PASSAGE))
        assert got["repeated_passages"][k].encode() == bytes(b for a, b in enumerate(raw) if a not in gone)
    assert PASSAGE == 240 and all(271 <= len(p) <= 394 for p in short)
    left = got["repeated_passages"]
    assert all(p not in left[230 + 2 * k + j] for k, p in enumerate(short) for j in range(2))
    assert all(edges[0] in left[240 + j] and edges[1] not in left[242 + j] for j in range(2))
    assert passage not in "".join(got["repeated_passages"].values()) and got["repeated_passages"][5] == texts[5]

    clean = got["personal_data"]
    assert set(clean) == set(got["repeated_passages"]) and not any(plain_spans(t) for t in clean.values())
    assert clean[5] == texts[5] and "[EMAIL]" in clean[220] and "[PHONE]" in clean[220]
    assert all(r["n_chars"] == len(r["text"]) for r in stages["personal_data"].collect())
    check_packing(stages["packed_sequences"].collect(), list(clean.items()))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stages["packed_sequences"].count()


def test_empty_table_and_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own pass through all stages but the last."""
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, part string, n bigint, label bigint, term string"
    empty = spark.createDataFrame([], schema)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packed_sequences" or out.columns == empty.columns)
