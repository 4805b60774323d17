"""Operators on documents against plain Python."""

import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from almanack.llm import toxicity
from almanack.llm.decontaminate import contaminated
from almanack.llm.line_dedup import LineRuns, dedup_lines, keyed_lines, repeated_lines
from almanack.llm.near_dedup import bands_for, components, least_matches, near_duplicates
from almanack.llm.packing import PIECE, pack, patterns_for
from almanack.llm.suffix_dedup import common_prefixes, remove_repeats, suffix_ranks
from almanack.llm.token_files import read_documents, read_token_range, with_checksums, write_token_files
from almanack.llm.tokens import WordCachedTokenizer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


# ---------------------------------------------------------------- repeated strings


def without_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 64), (40, 12)])
def test_repeated_strings_match_brute_force(docs, length, gram):
    got = remove_repeats(docs, length=length, gram=gram).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(d, *x) for (d, _), x in zip(texts, without_repeats([t for _, t in texts], length), strict=True)]
    key = lambda r: (r[0] or -1, r[1:])
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=key)
    assert got == sorted(want, key=key)


def test_split_anchor_is_merged_across_shards(llm_spark, monkeypatch):
    from almanack.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SPLIT", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD", 8)
    from fixtures import prose

    passage = prose(50, 12)
    rows = [(i, prose(100 + i, 10) + passage + prose(300 + i % 9, 10)) for i in range(25)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in remove_repeats(llm_spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=12).collect()}
    want = without_repeats([t for _, t in rows], 40)
    assert got == {i: x[1:3] for (i, _), x in zip(rows, want, strict=True)}


def test_hot_anchors_are_joined_in_parts(llm_spark, docs, monkeypatch):
    from almanack.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PART", 3)
    monkeypatch.setattr(suffix_dedup, "KEYS", 1000)
    from fixtures import prose

    passage = prose(51, 30)
    rows = [(i, prose(400 + i, 8) + passage + ("z" * 90 if i % 4 else "")) for i in range(30)]
    rows = llm_spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string")
    every = suffix_dedup.segments(suffix_dedup.row_key(rows), 40, 12).cache()
    counts = every.groupBy("m").count()
    hot = suffix_dedup.hot_keys(counts, ["m"], "count")
    parts = {r["m"]: r["n_parts"] for r in hot.collect()}
    assert parts == {r["m"]: -(-r["count"] // 3) for r in counts.where("count > 3").collect()} and max(parts.values()) >= 10
    joined = suffix_dedup.spread_join(every, counts, hot, ["m"]).select(every.columns)
    assert sorted(joined.collect()) == sorted(every.collect())
    every.unpersist()
    got = suffix_dedup.remove_repeats(rows, length=40, gram=12).collect()
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    want = [(d, x[1], x[2], x[3]) for (d, _), x in zip(texts, without_repeats([t for _, t in texts], 40), strict=True)]
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=key) == sorted(want, key=key)


def test_anchors_of_texts_beyond_16_mb():
    import numpy as np

    from almanack.llm.suffix_dedup import segments_of

    draw = np.random.default_rng(1)
    block = np.concatenate([draw.integers(97, 123, 300), np.tile(draw.integers(97, 123, 7), 60), draw.integers(97, 123, 300)]).astype(np.uint8)
    long = draw.integers(97, 123, (1 << 24) + 2000).astype(np.uint8)
    at = (1 << 24) - 500
    long[at : at + len(block)] = block

    def anchors(data, first):
        _, start, strings, m, _ = segments_of(data, np.array([0, len(data)]), 200, 64)
        by_string = {int(a) + i: int(h) for a, n, h in zip(start, strings, m, strict=True) if a + n > first for i in range(n)}
        return [by_string[first + i] for i in range(len(block) - 199)]

    assert anchors(long, at) == anchors(block, 0)


def test_segments_that_are_too_long_are_refused(no_docs):
    with pytest.raises(ValueError, match="gram"):
        remove_repeats(no_docs, length=5000, gram=64)
    assert remove_repeats(no_docs).count() == 0


def test_suffix_order_and_common_prefixes():
    import numpy as np

    data = np.frombuffer(b"banana band ananas banana band" * 3 + bytes(60), np.uint8)
    n, depth = len(data) - 40, 24
    order, _ = suffix_ranks(data[: n + depth], depth)
    raw = data.tobytes()
    keys = [raw[i : i + depth] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(n))
    shared = common_prefixes(data, order, depth)
    for a, b in zip(order[:-1], order[1:], strict=True):
        same = next((k for k in range(depth) if raw[a + k] != raw[b + k]), depth)
        assert shared[b] == same


def test_anchors_are_counted_without_segment_hashes(docs, monkeypatch):
    from almanack.llm import suffix_dedup

    keyed = suffix_dedup.row_key(docs)
    want = Counter(r["m"] for r in suffix_dedup.segments(keyed, 40, 12).select("m").collect())
    assert Counter(r["m"] for r in suffix_dedup.anchor_hashes(keyed, 40, 12).collect()) == want and max(want.values()) > 1
    monkeypatch.setattr(suffix_dedup, "spans_hash", None)
    assert len(suffix_dedup.anchored_runs(np.zeros(300, np.uint8), np.array([0, 300]), 40, 12)[2]) > 0


@pytest.mark.parametrize("width", [1, 12, 64, 300])
def test_hashes_of_grams_are_those_of_spans(width):
    from almanack.llm.common import grams_hash, spans_hash

    data = np.random.default_rng(2).integers(0, 256, 300).astype(np.uint8)
    at = np.arange(len(data) - width + 1)
    assert (grams_hash(data, width, seed=3) == spans_hash(data, at, at + width, seed=3)).all()


@pytest.mark.parametrize("bits", [20, 50, 64])
def test_keys_too_wide_to_hold_their_place_are_ordered_alike(bits):
    from almanack.llm.suffix_dedup import in_order

    keys = np.random.default_rng(3).integers(0, 1 << 10, 40_000).astype(np.uint64) << np.uint64(bits - 10)
    order, held = in_order(keys, bits)
    want = np.argsort(keys, kind="stable")
    assert (order == want).all() and (held == keys[want]).all()


def test_suffix_arrays_cost_a_few_sorts():
    """CPU time in units of a sort of as many random numbers, so that it doesn't depend on the machine."""
    from time import process_time

    from fixtures import prose

    from almanack.llm import suffix_dedup

    raw, size = prose(70, 250_000).encode(), 263
    texts = [raw[i * size : (i + 1) * size] for i in range(4000)]
    texts += [t[:230] + texts[i - 1][:33] for i, t in enumerate(texts)]
    shards = [texts[k :: max(1, len(texts) // suffix_dedup.SHARD)] for k in range(max(1, len(texts) // suffix_dedup.SHARD))]
    keys = np.random.default_rng(4).integers(0, 1 << 62, len(texts) * size)

    def seconds(work):
        start = process_time()
        out = work()
        return process_time() - start, out

    sort = min(seconds(lambda: np.argsort(keys, kind="stable"))[0] for _ in range(3))
    runs = [seconds(lambda: [suffix_dedup.repeats_of_shard(s, np.ones(len(s), np.int64), 200) for s in shards]) for _ in range(3)]
    assert all(sum((weight > 1).sum() for *_, weight in out) >= 2 * 4000 * 31 for _, out in runs)
    assert min(s for s, _ in runs) < 4 * sort


# ---------------------------------------------------------------- tokens


def test_cached_tokenizer_gives_the_tokenizers_ids(plain):
    texts = ["", "  ", "It's Ünïcode, İstanbul. 12,5 x²\x1c ǅ", "a\x0bb\x0cc\x85d é ́", "<|endoftext|> End", "naïve naïve. NAÏVE..,"]
    ids, ends = WordCachedTokenizer(TOKENIZER).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [plain(t) for t in texts]


def test_forms_of_a_word_are_looked_up_together(plain):
    stems = ["".join("bdgklmnprst"[i // 11**k % 11] + "aeiou"[i % 5] for k in range(3)) + "xé"[i % 2] for i in range(600)]
    text = " ".join(form for w in stems for form in (w, w.title(), f"{w}.", f"{w.title()},", f"{w.upper()}..", f"{w}.,", f"{w.upper()}", f"{w},"))
    coder, calls = WordCachedTokenizer(TOKENIZER), []
    sys.setprofile(lambda frame, event, what: calls.append(event) if event in ("call", "c_call") else None)
    try:
        ids, _ = coder.encode(pa.array([text]))
    finally:
        sys.setprofile(None)
    assert ids.tolist() == plain(text)
    assert len(calls) < 8 * len(stems)  # less than one call per form
    for limit in (4, 1_000):  # halves that are full at once
        coder.limit = limit
        assert [coder.encode(pa.array([t]))[0].tolist() for t in (text, "", text[:3_000], text)] == [plain(t) for t in (text, "", text[:3_000], text)]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(llm_spark, docs, plain, tmp_path, encoding):
    path = f"{tmp_path}/{encoding}"
    write_token_files(docs, path, tokenizer=TOKENIZER, encoding=encoding, page_bytes=4096)
    rows = with_checksums(read_documents(llm_spark, path)).orderBy("start").collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, crc(plain(r["text"]) + [1])) for r in docs.collect()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in rows) == want
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    total = 0
    for r in rows:
        assert r["start"] == total
        total += r["n_tokens"]
    assert read_token_range(llm_spark, path, 10, 10).first()["ids"] == [*plain("two words"), 1]
    assert "ids" not in read_documents(llm_spark, path, with_ids=False).columns


def test_token_files_grow_in_number_with_the_text(llm_spark, docs, tmp_path):
    total = sum(len((r["text"] or "").encode()) for r in docs.collect())
    few, many = f"{tmp_path}/few", f"{tmp_path}/many"
    write_token_files(docs, few, tokenizer=TOKENIZER)
    write_token_files(docs, many, tokenizer=TOKENIZER, part_bytes=total // 9)
    files = [read_documents(llm_spark, path).select("part").distinct().count() for path in (few, many)]
    assert files[0] <= 2 < 5 < files[1] <= 10
    rows = [[tuple(r) for r in with_checksums(read_documents(llm_spark, path)).select("start", "doc_id", "ids_crc32").orderBy("start").collect()] for path in (few, many)]
    assert rows[0] == rows[1]


def test_reading_token_files_shuffles_no_ids(llm_spark, docs, tmp_path):
    write_token_files(docs, f"{tmp_path}/some", tokenizer=TOKENIZER)
    most = llm_spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    llm_spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the files were large
    try:
        plan = read_documents(llm_spark, f"{tmp_path}/some")._jdf.queryExecution().executedPlan().toString()
    finally:
        llm_spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_token_files_of_no_rows(llm_spark, no_docs, tmp_path):
    write_token_files(no_docs, f"{tmp_path}/none", tokenizer=TOKENIZER)
    assert read_documents(llm_spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("size", [4096, 256])
def test_pieces_cover_documents_and_sequences(docs, plain, size):
    pieces = pack(docs, tokenizer=TOKENIZER, size=size, classes=64).select(PIECE).collect()
    rows = Counter((r["doc_id"], tuple([*plain(r["text"]), 2])) for r in docs.collect())
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p["doc_id"]].append(p)
        of_sequence[p["sequence_id"]].append(p)
    for (doc, ids), times in rows.items():
        assert sum(p["length"] for p in of_doc[doc]) == times * len(ids)
        for p in of_doc[doc]:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]])
    for found in of_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == size or at & (at - 1) == 0


def test_packing_no_rows(no_docs):
    assert pack(no_docs, tokenizer=TOKENIZER).count() == 0


def test_linear_program_is_near_its_bound():
    import numpy as np

    demand, units = np.array([40.0, 70, 15, 90, 3]), np.array([60, 45, 33, 20, 7])
    patterns, amounts = patterns_for(demand, units, 100)
    assert np.allclose(amounts @ patterns, demand) and (patterns @ units <= 100).all()
    assert amounts.sum() <= max((demand @ units) / 100, 40 + 70 / 2) * 1.2


# ---------------------------------------------------------------- lines


def line_result(rows):
    blanks, lowered = " \t\n\x0b\x0c\r", lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line).strip(blanks)
            if doc is not None and len(key) >= 10:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or first.get(lowered(x).strip(blanks), doc) == doc]
        out.append((doc or -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("batches", "fan_out"), [(1, 2), (5, 2)])
def test_lines_match_brute_force(docs, batches, fan_out):
    got = dedup_lines(docs, batches=batches, fan_out=fan_out)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect())
    assert got == line_result([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_runs_are_compacted(llm_spark):
    runs = LineRuns(llm_spark, fan_out=2)
    for n in range(4):
        batch = llm_spark.createDataFrame([(n, f"line number {n} of the batch\na line in each batch")], "doc_id long, text string")
        lost = repeated_lines(batch, runs).count()
        assert lost == (n > 0)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    held = llm_spark.table(runs.run_names()[0])
    assert held.count() == 5 and held.select("h1", "h2").distinct().count() == 5
    runs.close()


def test_lines_of_no_rows(no_docs):
    assert dedup_lines(no_docs).count() == 0
    assert keyed_lines(no_docs, 10).count() == 0


# ---------------------------------------------------------------- near duplicates


def near_result(rows, words, num, den):
    sets = defaultdict(set)
    for doc, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted((d, len(sets[d]), comp[d], comp[d] == d) for d, _ in rows)


def test_near_duplicates_match_brute_force(llm_spark, docs):
    from fixtures import prose

    base = prose(77, 100).split()
    chain = []
    for n in range(9):  # each close to the next, the ends far apart
        base[10 * n] = f"edit{n}"
        chain.append((100 + n, " ".join(base)))
    frame = docs.select("doc_id", "text").union(llm_spark.createDataFrame(chain, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = near_duplicates(frame, words=3, num=85, den=100).collect()
    named = sorted(tuple(r) for r in got if r["doc_id"] is not None)
    assert named == near_result([r for r in rows if r[0] is not None], 3, 85, 100)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_near_duplicates_of_no_rows(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_bounds_of_verification():
    assert bands_for(0.85, 1e-5) == 16
    assert least_matches(0.85, 1e-6, 64)[1] > least_matches(0.85, 1e-6, 64)[0]


def test_components_of_a_long_path(llm_spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101)]
    got = {r["node"]: r["comp"] for r in components(llm_spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_intermediate_tables_go(llm_spark, docs, tmp_path, monkeypatch):
    """What stays is what the result still reads."""
    from almanack.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark, what: f"{tmp_path}/{what}-{common.uuid.uuid4().hex}")
    result = near_duplicates(docs, words=3, num=85, den=100)
    left = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert left.count("classes") == 1 and not {"signatures", "members"} & set(left) and left.count("edges") <= 3
    assert result.count() == docs.count()


class Task:
    """In place of a table: gives the function that a task would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_memory_of_signing_is_bounded():
    """A worker signs 8 MB of short texts, or one of 4 MB, in little memory, and keeps hardly any of it."""
    import tracemalloc

    from almanack.llm import common, near_dedup

    words = [f"w{zlib.crc32(str(i).encode()):x}" for i in range(40_000)]
    short = [" ".join(words[i % 399 * 100 :][:200]) + f" {i}" for i in range(4_400)]
    long = " ".join(words[(i * i + i // 7) % 40_000] for i in range(430_000))
    for column, texts, most in (("doc_id", short, 60e6), ("id", short, 60e6), ("doc_id", [long], 130e6)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], [column, "text"])
        assert batch.nbytes > 4e6
        run = near_dedup.signed(Task(), 5, 22) if column == "doc_id" else near_dedup.with_sets(Task(), 5)
        common._POWERS.clear()
        tracemalloc.start()
        rows = sum(b.num_rows for b in run([batch]))
        kept, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert rows == len(texts) and peak < most and kept < 20e6


def test_word_hashes_dont_depend_on_blocks(docs, monkeypatch):
    from almanack.llm import shingles

    texts = pa.array([r["text"] or "" for r in docs.collect()] + ["x" * 500 + " y"])
    whole, places = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "BLOCK", 7)
    parts, same = shingles.word_hashes(texts)
    assert (whole == parts).all() and (places == same).all() and len(whole) == sum(len(t.encode().split()) for t in texts.to_pylist())
    assert [len(x) for x in shingles.word_hashes(pa.array(["", " "]))] == [0, 3]


def test_unfinished_components_are_an_error(llm_spark):
    path = llm_spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        components(path, most=2)



# ---------------------------------------------------------------- decontamination


def test_leaks_are_found_and_clean_texts_left(llm_spark):
    item = "A train leaves Berlin at 40 km per hour and reaches the town near Potsdam after 3 hours of slow travel"
    other = item.replace("Berlin", "Madrid").replace("Potsdam", "Toledo").replace("40", "75").replace("3 hours", "9 hours")
    twice = "In May Anna gave Bert 5 apples so that Anna had 5 left and then Bert gave Anna 5 pears in return"
    mixed = twice.replace("Anna", "Carl", 1).replace("Anna", "Dora", 1).replace("5", "6", 1).replace("5", "7", 1)
    rows = [
        (1, "Before it. " + item.upper().lower() + " and after."), (2, "Intro words here.\n" + other + "\nmore"), (3, item), (4, twice.replace("Anna", "Eve")),
        (5, "Text " + mixed), (6, "Nothing of the kind is said here about trains leaving towns at any speed whatever"), (7, None), (8, ""), (3, item),
        (None, item), (9, "short item text"),
    ]
    docs = llm_spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = llm_spark.createDataFrame([(1, item), (2, twice), (3, "short item text"), (4, None), (None, "row without id here"), (1, item)], "item_id long, text string")
    got = contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 2), (9, 3)]
    # In lower case the names are no slots, so only windows without them match.
    loose = contaminated(docs, bench, coverage=0.1).collect()
    assert (1, 1) in {(r["doc_id"], r["item_id"]) for r in loose}
    assert contaminated(docs.where("false"), bench).count() == 0
    assert contaminated(docs, bench.where("false")).count() == 0


def leaks_of(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect())


def test_edited_and_partial_copies_are_leaks(llm_spark):
    words = "while the old miller kept his grain under a low wooden roof near the quiet river two boys carried sacks along narrow paths and sold bread before every market opened so nobody in that valley went hungry"
    item, half = words.split()[:38], "around which someone had talked of other matters for quite some time already"
    longer, changed = [*item[:19], "really", *item[19:]], [*item[:20]]
    changed[10] = "stone"
    passage = " ".join(item[3:17])
    docs = [" ".join(longer), " ".join(changed), f"{half} {passage} {half}", f"{half} {' '.join(item[3:13])} {half}"]
    got = leaks_of(llm_spark, docs, [" ".join(item), " ".join(item[:20])])
    assert {(0, 0), (1, 1), (2, 0)} <= set(got) and 3 not in {d for d, i in got if i == 0}


def test_slots_are_compared_inside_matches(llm_spark):
    names = "so Anna met Bert near his house and Anna told Bert about 5 dogs while Carl saw Anna and Bert with 5 cats before Dora gave Anna 7 birds"
    typo = names.replace("Anna", "Eva").replace("Bert", "Max").replace("Eva", "Ewa", 1)
    cut = " ".join(names.replace("Anna", "Eva").split()[:22]) + " after which Karl went home and Otto and Paul and Hugo and 9 others slept a while"
    docs = [typo, cut, "so Eva met Max near his house and Ida told Tim about 8 dogs while Carl saw Pia and Jan with 3 cats before Dora gave Lea 7 birds"]
    assert leaks_of(llm_spark, docs, [names]) == [(0, 0), (1, 0)]


def test_names_in_any_place_and_case(llm_spark):
    item = "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have"
    docs = [item.replace("Tom", "Anna"), item.upper(), item.lower(), item.replace("Tom", "Mary Ann Smith"), "Yes", "NO WAY OUT"]
    assert leaks_of(llm_spark, docs, [item, "No", "Paul Brown Junior Of Green Hill West Side"]) == [(0, 0), (1, 0), (2, 0), (3, 0), (5, 1)]


def test_short_items_inside_documents(llm_spark):
    docs = ["We ask here: who wrote the red book? Nobody in this long text knows it at all.", "Who wrote the blue book? Nobody in this long text knows.", "who wrote"]
    assert leaks_of(llm_spark, docs, ["Who wrote the red book", "long text", "absent"]) == [(0, 0), (0, 1), (1, 1)]


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_rows(llm_spark):
    root = "/root/testdata/sf0.1"
    docs = llm_spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    labels = llm_spark.read.parquet(f"{root}/labels.parquet")
    model = toxicity.train(docs, labels)
    tested = docs.join(labels.where(toxicity.held_out(F.col("doc_id"))), "doc_id")
    rows = toxicity.score(tested, model).select("toxic", "toxicity").collect()
    right = sum((r["toxicity"] >= 0.5) == bool(r["toxic"]) for r in rows)
    caught = [r["toxicity"] >= 0.5 for r in rows if r["toxic"]]
    assert right >= 0.97 * len(rows) and sum(caught) >= 0.9 * len(caught)


def test_toxicity_of_odd_rows(docs, no_docs, llm_spark):
    labels = llm_spark.createDataFrame([(1, 0), (4, None), (None, 1), (5, 0), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, "score")
    assert rows.columns == ["doc_id", "text", "n", "h1", "score"]
    assert {r["score"] for r in rows.collect()} == {0.0}
    assert toxicity.score(no_docs, model).count() == 0
    texts = [("such scum and trash", 1), ("kind words here", 0)] * 3 + [(f"good {w} day", 0) for w in "abcdefghij"]
    fitted = toxicity.fit([(" ".join(sorted({*t.split(), f"w{i}x"})), y) for i, (t, y) in enumerate(texts)], support=1)
    assert fitted.score("what SCUM!") > 0.5 > fitted.score("a kind day") and fitted.score("") < 0.5


def test_remembered_words_are_bounded(monkeypatch):
    model = toxicity.ToxicityModel(["scum", "aabc++", "bcd+"], np.array([0.5, 0.25, -0.125, 0.1, 0.2, 0.3]), -1.0)
    text = "vile scum " + " ".join("".join(chr(97 + int(c)) for c in str(n)) for n in range(150_000))
    first = model.score(text)
    assert len(model.cache) <= 100_000 and {0, 2} <= model.fired(toxicity.words_of(text))
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    assert model.score(text) == first and len(model.cache) <= 3


def test_training_rows_are_bounded(llm_spark):
    """A repeated id is one row, and a text of any vocabulary reaches the driver in bounded bytes."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    toxic, calm = (next(n for n, i in enumerate(ids) if (i % 4 == 0) == kind) for kind in (True, False))
    rows = [(i, "you vile rotten scum" if i % 4 == 0 else "a calm note on trains") for i in ids] + [(ids[toxic], "you vile rotten scum")] * 500
    rows[calm] = (ids[calm], " ".join(f"w{''.join(chr(97 + int(c)) for c in str(n))}" for n in range(30_000)))
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    labels = llm_spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids] + [(ids[toxic], 1)] * 50, "doc_id long, toxic int")
    once = toxicity.train(docs.dropDuplicates(["doc_id"]), labels.distinct())
    many = toxicity.train(docs, labels, max_rows=1_000)
    assert many.voters == once.voters and list(many.weights) == pytest.approx(list(once.weights))
    words = toxicity.words_of(rows[calm][1])
    kept = list(toxicity.bounded(words, 1_000))
    assert 900 < len(" ".join(kept).encode()) <= 1_000 and set(kept) < words
    assert set(toxicity.bounded(words, 1 << 20)) == words and set(toxicity.bounded(set(), 10)) == set()


def test_dependent_voters_count_less():
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(0))
    truth = draw.random(4000) < 0.2
    one = (truth & (draw.random(4000) < 0.7)).astype(float)
    free = (truth & (draw.random(4000) < 0.7)).astype(float)
    given = np.where(draw.random(4000) < 0.02, ~truth, truth).astype(float)
    votes = np.stack([one, one, one, free, ((one + free) == 0).astype(float), given], axis=1)
    posterior, rates, weight = toxicity.label_model(votes, 0.2)
    assert weight[0] < 0.5 < weight[3]
    assert ((posterior > 0.5) == truth).mean() > 0.95 and abs(rates[1][3] - 0.7) < 0.1


def test_hash_of_held_out_rows(llm_spark):
    rows = llm_spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
