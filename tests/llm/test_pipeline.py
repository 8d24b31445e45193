"""The pipeline stage by stage, each on the rows its predecessor kept, against plain versions."""

import math
import statistics
import zlib

import numpy as np
import pytest
import test_fertility_and_ngrams
import test_minhash
import test_records_and_packing
import test_spaced_seeds
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import fertility, personal_data

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "light", "garden", "winter") for b in ("", "s", "ly", "ing", "fall", "side")]
    text = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    items = [" ".join(text(n)) for n in (16, 25, 40)]
    texts = [" ".join(text(int(n))) for n in rng.integers(60, 400, 70)]
    for i in (3, 9, 9):
        words = texts[i].split()
        words[20:22] = ["other", "words"]
        texts.append(" ".join(words))
    fresh = lambda: " ".join(text(int(rng.integers(90, 250))))
    texts += [texts[5], texts[5] + " end", fresh() + " " + items[0], fresh() + " " + items[1].replace(" ", " . ", 2), items[2] + " " + fresh(),
              " ".join(text(700)) + " write to jo@mail.org or +1 (017) 555-7713 from 10.1.2.3 now", fresh() + " jo.doe(at)mail.org",
              "!! ".join(fresh().upper().split()) + "!!", "###".join(fresh().split()), "", None, "too short", "again and again " * 60, fresh() * 30]
    ids = rng.permutation(500)[:len(texts)].tolist()
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in zip(ids, texts)]
    rows += [rows[2], (None, texts[19], "en", None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def plain_quality(rows):
    counter = fertility.PieceCounter(test_fertility_and_ngrams.MODEL)
    found = [(r, fertility.measure(r[1] or "", counter)) for r in rows]
    figures, failed = [], []
    for r, m in found:
        words, chars, *_, again, tokens, fallen, entropy = m
        failed.append(words < 50 or 100 * again > 50 * words)
        n = max(1, tokens)
        figures.append({"chars_per_token": chars / n, "words_per_token": words / n, "byte_share": fallen / n, "entropy": entropy,
                        "wide": math.sqrt(1 + fertility.SHORT / n), "language": r[2] or "", "size": int(math.log2(n))})
    sound = [f for f, bad in zip(figures, failed) if not bad]
    kept = [not f for f in failed]
    for name, group in (("chars_per_token", "language"), ("words_per_token", "language"), ("byte_share", "language"), ("entropy", "size")):
        middles, spreads, counts = {}, {}, {}
        for value in sorted({f[group] for f in sound}):
            of = [f for f in sound if f[group] == value]
            counts[value], middles[value] = len(of), statistics.median(round(f[name], 3) for f in of)
            spreads[value] = statistics.median(abs(round((round(f[name], 3) - middles[value]) / f["wide"], 3)) for f in of)
        usual = sum(counts[v] * spreads[v] for v in counts) / sum(counts.values())
        places = [v if group == "size" else 0 for v in counts]
        straight = np.polyfit(places, list(middles.values()), 1) if len(set(places)) > 1 else [0, statistics.mean(middles.values())]
        expected = {v: straight[0] * place + straight[1] for v, place in zip(counts, places)}
        between = statistics.mean((middles[v] - expected[v]) ** 2 for v in counts)
        low, high = fertility.BANDS[name]
        for i, f in enumerate(figures):
            v = f[group]
            if kept[i]:
                share = fertility.PRIOR / (counts[v] + fertility.PRIOR)
                own = 1.4826 * ((1 - share) * spreads[v] + share * usual)
                trust = own ** 2 / counts[v] / (own ** 2 / counts[v] + between) if own or between else 0
                centre = (1 - trust) * middles[v] + trust * expected[v]
                unit = math.hypot(own, math.sqrt(trust * between))
                unit = max(unit, fertility.LEAST_SPREAD * (1 if name == "byte_share" else centre))
                kept[i] = -low * unit <= (round(f[name], 3) - centre) / f["wide"] <= high * unit
    return [r for r, k in zip(rows, kept) if k]


def test_stages(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "decontamination", "personal_data", "best_fit_packing"]

    docs = corpus_pipeline.quality_rules(spark, docs, folder)
    assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    rows = plain_quality(rows)
    assert sorted(map(tuple, docs.collect()), key=key) == sorted(rows, key=key) and 70 < len(rows)
    assert not any("!!" in r[1] for r in rows)

    docs = corpus_pipeline.near_copies(spark, docs, folder)
    component = {(d, t): c for d, t, c in test_minhash.brute_rows([r[:2] for r in rows], 5, 80)}
    rows = list({r[:2]: r for r in rows if r[0] is None or component[r[:2]] == r[0]}.values())
    assert sorted(map(tuple, docs.collect()), key=key) == sorted(rows, key=key)

    docs = corpus_pipeline.decontamination(spark, docs, folder)
    bad = {d for d, _ in test_spaced_seeds.brute([r[:2] for r in rows], list(enumerate(items)))}
    rows = [r for r in rows if r[0] not in bad]
    assert len(bad) == 3 and sorted(map(tuple, docs.collect()), key=key) == sorted(rows, key=key)

    docs = corpus_pipeline.personal_data_masking(spark, docs, folder)
    masked = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")] and len(masked) == len(rows)
    for r in rows:
        text = masked[r[0]]["text"]
        assert masked[r[0]]["n_chars"] == len(text) and personal_data.rules(text) == []
        assert text == r[1] or any(s in r[1] for s in ("jo@mail.org", "jo.doe(at)mail.org"))
    changed = [m["text"] for m in masked.values() if "<" in m["text"]]
    tails = [t[-45:] for t in changed]
    assert any(t.endswith("write to <EMAIL> or <PHONE> from <IP> now") for t in tails) and any(t.endswith(" <EMAIL>") for t in tails), tails

    packed = corpus_pipeline.best_fit_packing(spark, docs, folder).collect()
    encode, lengths = test_records_and_packing.plain("word_bpe_49k.json"), []
    pieces = {(r["doc_id"], r["piece"]): r for r in packed}
    for doc, m in masked.items():
        ids = encode(m["text"]) + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at:at + 4096]
            lengths.append(len(own))
            assert (pieces[doc, n]["start"], pieces[doc, n]["length"], pieces[doc, n]["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    used = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(packed) == len(lengths) and sorted(4096 - u for u in used.values()) == test_records_and_packing.best_fit(lengths, 4096)

    whole = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")
    assert sorted(map(tuple, whole.collect()), key=key) == sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed], key=key)


def test_empty_documents(spark, corpus, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_columns_beyond_those_of_documents(spark, corpus):
    """Names that the operators use inside may be columns of the table."""
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(1) for c in ("kept", "node", "entropy", "text_hash", "masked", "spans", "c0", "_of_size", "n_tokens", "_doc", "_hash", "_near_doc", "_near_hash", "own_doc", "own_hash", "gone_doc", "component_id", "h")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns and made.count() > 50, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 50
