"""The whole pipeline against plain loops over a small table."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lexarbor.llm import byte_bpe, language_id
from tests.llm.test_llm import components_by_hand, mixed_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = np.random.default_rng(12)
    letters = {"en": "the and house garden of with window morning light river stone".split(), "de": "das und haus garten von mit fenster morgen licht fluss stein".split(), "es": "el y casa jardin de con ventana manana luz rio piedra".split()}
    shared = "this very line is found in a great many documents of the table"
    rows = []
    for i in range(150):
        lang = list(letters)[i % 3]
        lines = [" ".join(rng.choice(letters[lang], rng.integers(6, 14))) + f" {lang}{i}x{k}" for k in range(rng.integers(1, 6))]
        if i % 4 == 0:
            lines.insert(int(rng.integers(0, len(lines) + 1)), shared.upper() if i % 8 else f"  {shared}\t")
        rows.append([i, "\n".join(lines), None if i % 11 == 0 else lang, ("web", "book", "news", None)[int(rng.integers(0, 4))]])
    for i in range(150, 190):
        words = rows[(i - 150) // 4][1].split(" ")
        words[int(rng.integers(0, len(words)))] = f"new{i}"
        rows.append([i, " ".join(words) if i % 3 else rows[(i - 150) // 4][1], "en", "copy"])
    rows += [[200, None, "en", "web"], [201, "", "en", "web"], [202, "12 + 34 = 46 !", "en", "web"], [203, "\u4e00\u4e8c \u4e09\u56db\u4e94 " * 30, None, "web"], [204, "short text", None, None]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def languages_kept(rows):
    learn = sorted((r[0], r[1], r[2]) for r in rows if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 5)
    model = language_id.fit([x[1] for x in learn], [x[2] for x in learn])
    out = []
    for doc_id, text, _, source, n in rows:
        if not text or not any(c.isalpha() for c in text):
            continue
        own = language_id.grams(text)
        values = np.isin(model.vocabulary, own).astype(float) @ model.weights / np.sqrt(len(own))
        if values.max() >= next(least for chars, least in corpus_pipeline.LANGUAGE_LIMITS if len(text) < chars):
            out.append((doc_id, text, model.languages[int(values.argmax())], source, n))
    return out


def lines_dropped(rows):
    key = lambda line: line.strip(" \t\n\v\f\r").lower()
    where = {}
    for doc_id, text, *_ in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                where.setdefault(key(line), set()).add(doc_id)
    gone = {k: max(ids) for k, ids in where.items() if len(ids) >= 5}
    out = []
    for doc_id, text, *rest in rows:
        kept = "\n".join(x for x in text.split("\n") if gone.get(key(x), doc_id) == doc_id)
        out.append((doc_id, kept, *rest[:-1], len(kept)))
    return out


def near_copies_dropped(rows):
    found = components_by_hand([r[1] for r in rows])
    least = {}
    for i, r in enumerate(rows):
        least[found[i][1]] = min(r[0], least.get(found[i][1], r[0]))
    return [r for i, r in enumerate(rows) if least[found[i][1]] == r[0]]


def mixed(rows):
    key = lambda r: int(hashlib.md5("\x1f".join("" if x is None else str(x) for x in r).encode()).hexdigest()[:15], 16)
    sizes, targets = mixed_by_hand([(r[3], len(r[1].split())) for r in rows])
    out = []
    for source in sizes:
        epochs = int(targets[source] // sizes[source]) if sizes[source] else 0
        left, upto = targets[source] - epochs * sizes[source], 0
        for r in sorted((r for r in rows if r[3] == source), key=key):
            n = len(r[1].split())
            upto += n
            out += [r] * ((epochs + (upto - n / 2 <= left)) if n else 0)
    return out


def encoded(rows):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return [(r[0], len(ids := own.encode_ordinary(r[1])), sha(np.array(ids, "<u4").tobytes()), sha(r[1].encode())) for r in rows]


def test_pipeline_equals_plain_loops(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    loops = [languages_kept, lines_dropped, near_copies_dropped, mixed]
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    text = lambda r: tuple(map(str, r))
    for (name, stage), loop in zip(corpus_pipeline.STAGES, loops, strict=False):
        docs, before, want = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name), want, loop(want)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        assert sorted(map(text, docs.collect())) == sorted(map(text, want)), name
        assert want != before, f"{name} has nothing to do here"
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, out)) == sorted(encoded(want))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "the house and the garden of the house", "en", "a", 5)] * 3])
def test_pipeline_of_tiny_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows if r[1]}


def test_clean_short_texts_stay(spark):
    letters = "the and house garden of with window morning light river stone".split()
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(letters, 30)), "en", "a", 1) for i in range(60)] + [(100 + i, w, None, "a", 1) for i, w in enumerate(letters) if len(w) > 4] + [(200, "".join(rng.choice(list("qxzjkvbw"), 2000)), None, "a", 1)]
    frame = spark.createDataFrame(rows, COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, frame, "").collect()}
    assert kept == {r[0] for r in rows} - {200}
