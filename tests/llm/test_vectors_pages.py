"""Neighbours, archives, page texts and the pipeline against plain Python."""

import gzip
import hashlib
import html
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanack.llm import html_text, neighbours, warc
from almanack.llm.common import shared_folder, slices

# ---------------------------------------------------------------- neighbours


def exact(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in ids:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        out[int(q)] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def test_neighbours_find_most_and_break_ties_by_id(llm_spark):
    draw = np.random.Generator(np.random.PCG64(1))
    centres = draw.normal(size=(6, 12)) * 4
    rows = [(i, (centres[i % 6] + draw.normal(size=12)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # copies of one vector
    odd = [(5000, None), (5001, [0.0] * 12), (5002, [1.0] * 11 + [None]), (5003, [math.nan] + [1.0] * 11), (5004, [math.inf] + [0.0] * 11), (5005, [1.0]), (None, rows[3][1])]
    frame = llm_spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, node string")
    queries = frame.where("vec_id % 20 = 0 OR vec_id IN (7, 1003, 5001)")
    got = neighbours.search(neighbours.build(frame), queries).collect()
    want, found = exact(rows, 10), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {r[0] for r in rows if r[0] % 20 == 0} | {7, 1003}
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in want[q]}) for q in found)
    assert hits >= 0.9 * 10 * len(found)
    assert [v for v, _ in found[7]] == list(range(1000, 1010)) and found[1003][0] == (7, 0.0)
    assert all(abs(s - dict(want[q]).get(v, s)) < 1e-9 for q in found for v, s in found[q])


def test_neighbours_of_few_and_no_rows(llm_spark):
    frame = llm_spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got = neighbours.search(neighbours.build(frame), frame).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    none = frame.where("false")
    assert neighbours.search(neighbours.build(none), none).count() == 0


def test_neighbours_with_a_third_in_one_cluster_and_a_hub(llm_spark):
    draw = np.random.Generator(np.random.PCG64(4))
    near = draw.normal(size=(700, 8)) * 0.01
    far = draw.normal(size=(1_300, 8)) * 5
    far[:600] /= np.linalg.norm(far[:600], axis=1)[:, None] / 9  # a shell; its middle is near to all of it
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(np.vstack([near, far]))]
    frame = llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.search(neighbours.build(frame), frame.where("vec_id % 25 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows, 10)
    assert sum(len(found[q] & {v for v, _ in want[q]}) for q in found) >= 0.95 * 10 * len(found) and len(found) == 80


def test_neighbours_among_vectors_without_any_structure(llm_spark):
    draw = np.random.Generator(np.random.PCG64(9))
    x = draw.normal(size=(6_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    frame = llm_spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.search(neighbours.build(frame), frame.where("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 6_000, 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        hits += len(found[q] & set(np.argsort(d, kind="stable")[1:11].tolist()))
    assert hits >= 0.97 * 600


def test_the_graph_itself_holds_the_nearest_of_vectors_without_structure(llm_spark):
    # A graph that misses many makes the search double its beam, more often the larger the table is.
    draw = np.random.Generator(np.random.PCG64(12))
    x = draw.normal(size=(6_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    frame = llm_spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    edges = {}
    for r in neighbours.build(frame).edges.where("u % 20 = 0").collect():
        edges.setdefault(r["u"], set()).add(r["v"])
    hits = 0
    for q in range(0, 6_000, 20):
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        hits += len(edges[q] & set(np.argsort(d, kind="stable")[1:11].tolist()))
    assert hits >= 0.93 * 3_000, hits


def test_rounds_and_hops_move_rows_of_blocks_not_of_edges(llm_spark, monkeypatch):
    # A row for each edge, candidate and measured node made the time of a large table.
    draw = np.random.Generator(np.random.PCG64(15))
    frame = llm_spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(draw.normal(size=(4_500, 10)).astype(np.float32))], "vec_id long, embedding array<float>")
    kept, rows = neighbours.staged, {}

    def counted(df, what):
        out = kept(df, what)
        rows[what] = max(rows.get(what, 0), out.count())
        return out

    monkeypatch.setattr(neighbours, "staged", counted)
    graph = neighbours.build(frame)
    got = neighbours.search(graph, frame.where("vec_id % 100 = 0"))
    assert got.count() == 450 and rows["graph"] < 100 and rows["beam"] < 100, rows
    assert sorted(r["at"] for r in graph.nodes.select("at").collect()) == list(range(4_500))


def test_packets_go_out_in_bounded_parts_and_lose_nothing(monkeypatch):
    to = np.repeat([2, 3, 7, 8], [5, 1, 40, 2])
    slots, x = np.arange(48).astype(neighbours.SLOT), np.arange(96, dtype=np.float32).reshape(48, 2)
    monkeypatch.setattr(neighbours, "MOST", 100)
    got = neighbours.addressed(neighbours.FOUND, 1, to, slots, x)
    assert got.num_rows == 4 and got.column("a").num_chunks > 1 and neighbours.per_item(got, "block").tolist() == to.tolist()
    assert neighbours.whole(got, "a", neighbours.SLOT).tolist() == slots.tolist()
    assert (neighbours.whole(got.slice(1), "b", np.float32) == x[5:].ravel()).all()
    assert neighbours.addressed(neighbours.FOUND, 1, to[:0], slots[:0]).num_rows == 0


def test_repeated_queries_are_all_asked(llm_spark):
    draw = np.random.Generator(np.random.PCG64(3))
    rows = [(i, x.tolist()) for i, x in enumerate(draw.normal(size=(300, 8)).astype(np.float32))]
    graph = neighbours.build(llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = llm_spark.createDataFrame([rows[5], (5, rows[80][1]), rows[6]], "vec_id long, embedding array<float>")
    got = neighbours.search(graph, asked).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, r) for q in (5, 6) for r in range(1, 11)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 5 and r["rank"] == 1] == [(80, 0.0)]


def test_unfinished_graphs_and_searches_are_errors(llm_spark):
    draw = np.random.Generator(np.random.PCG64(6))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(draw.normal(size=(900, 6)))]
    frame = llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="still new"):
        neighbours.build(frame, rounds=1, still=0.0)
    graph = neighbours.build(frame)
    with pytest.raises(RuntimeError, match="isn't done"):
        neighbours.search(graph, frame.where("vec_id < 20"), hops=1)


# ---------------------------------------------------------------- archives


@pytest.fixture(scope="module")
def pages(llm_spark):
    big, noise = "<p>" + "copy " * 400 + "</p>", np.random.Generator(np.random.PCG64(2)).integers(32, 127, 60_000).tobytes()[::8].decode("latin-1")
    rows = [
        (1, "http://a/x y?ü=%41", big), (2, None, None), (3, "u\r\nX: y", ""), (4, "u", big), (5, "u", "short"), (6, "u", "short"), (7, "u", big),
        (8, "u", "\x1f\x8b\x08 WARC/1.1 in a text " * 90), (9, "u", noise), (7, "u", big), (None, "u", big), (10, "u", "é" * 700),
    ]
    return llm_spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("split_bytes", [1 << 22, 100])
def test_archives_round_trip(llm_spark, pages, split_bytes):
    manifest = warc.write_archives(pages, shared_folder(llm_spark, "warc"), max_file_bytes=5_000)
    got = warc.read_archives(llm_spark, manifest, split_bytes=split_bytes).collect()
    rows = [(r["page_id"], r["url"], (r["html"] or "").encode()) for r in pages.collect()]
    assert len(got) == len(rows) == manifest.agg(F.sum("records")).first()[0]
    for page, url, payload in rows:
        found = [r for r in got if r["page_id"] == page]
        keeper = max((p for p, _, x in rows if x == payload and p is not None), default=None)
        older = len(payload) >= 1000 and page is not None and page < keeper
        for r in found:
            assert r["url"] == url and r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
            assert (r["record_type"], r["refers_to"]) == (("revisit", keeper) if older else ("response", None))
            assert r["payload"] == (None if older else payload)


def test_archives_are_plain_gzip_members(llm_spark, pages):
    manifest = warc.write_archives(pages, shared_folder(llm_spark, "warc"))
    store, path = warc.open_store(manifest.first()["file"])
    with store.open_input_file(path) as source:
        assert gzip.decompress(source.read()).startswith(b"WARC/1.1\r\n")


def test_magic_inside_a_stored_payload_owns_no_record():
    import io

    inner = gzip.compress(warc.record(1, "u", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None))
    outer = gzip.compress(warc.record(2, "u", b"\x1f\x8b\x08 no member", hashlib.sha1(b"").hexdigest(), None), compresslevel=0)
    data = outer + inner + b"torn" + outer[:40]

    class Source(io.BytesIO):
        def read_at(self, size, at):
            return self.getvalue()[at : at + size]

    found = [at for at, _ in warc.members(Source(data), 0, len(data), len(data))]
    assert found == [0, len(outer)]
    cut = len(outer) - 5
    assert [at for at, _ in warc.members(Source(data), 0, cut, len(data))] == [0]
    assert [at for at, _ in warc.members(Source(data), cut, len(data), len(data))] == [len(outer)]


def test_records_of_other_writers(llm_spark, tmp_path):
    def member(head, block):
        head = [b"WARC/1.0", *head, b"Content-Length: %d" % len(block)]
        return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")

    body, sha = b"<p>one</p>\r\n\r\n<p>two</p>", hashlib.sha1(b"other").hexdigest()
    members = [
        member([b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:1>"], b"software: x\r\n"),
        member([b"warc-type:response", b"WARC-Target-URI: http://a/", b"WARC-Payload-Digest: sha1:" + b"A" * 32], b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body),
        member([b"WARC-Type: response", b"Broken header", b"X: \xff"], b"no http at all"),
        member([b"WARC-Type: revisit", b"WARC-Payload-Digest: sha1:" + sha.upper().encode()], b"HTTP/1.1 200 OK\r\ncontent-length: 5\r\n\r\n"),
        member([b"WARC-Type: revisit", b"WARC-Payload-Digest: md5:abc", b"WARC-Refers-To: <urn:uuid:9>"], b""),
        gzip.compress(b"WARC/1.0\r\n\r\n"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    files = llm_spark.createDataFrame([(str(tmp_path / "x.warc.gz"), sum(map(len, members)))], "file string, bytes long")
    got = [r[:7] for r in sorted(warc.read_archives(llm_spark, files, split_bytes=64).collect(), key=lambda r: r["start"])]
    assert got == [
        (None, None, "warcinfo", None, None, None, None),
        (None, "http://a/", "response", len(body), hashlib.sha1(body).hexdigest(), None, body),
        (None, None, "response", 14, hashlib.sha1(b"no http at all").hexdigest(), None, b"no http at all"),
        (None, None, "revisit", 5, sha, None, None),
        (None, None, "revisit", None, None, None, None),
        (None, None, None, None, None, None, None),
    ]


def test_a_digest_that_lies_is_not_believed():
    found = warc.parsed(warc.record(4, "u", b"payload", "00" * 20, None), True)
    assert found[3:5] == (7, hashlib.sha1(b"payload").hexdigest())


def test_archives_of_no_rows(llm_spark, pages):
    assert warc.archived(pages.where("false")).count() == 0


# ---------------------------------------------------------------- page texts


@pytest.fixture(scope="module")
def model():
    return html_text.train(None, templates=250)


def test_page_text_of_unseen_templates(model):
    right = total = 0
    for source, _ in html_text.template_pages(60, seed=77):
        page, inside = html_text.labelled(source)
        keep = html_text.decode(page, model.scores(html_text.features(page)))
        sizes = np.bincount([i for i, t in page.pieces if t], [len(t) for _, t in page.pieces if t], len(keep))
        total += sizes.sum()
        right += sizes[keep == (inside > 0)].sum()
    assert right >= 0.97 * total


def test_page_text_is_whole_and_in_order(model):
    words = "The quick brown fox, it is said, jumps over the lazy dog. "
    source = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li>"
        "<li><a href=/b>More</a></li></ul></nav><!-- <p>no</p> --><article><h1>Head &amp; <b>line</b></h1><p>" + words * 3 + "<br>next&nbsp; line"
        "<p><b>" + words * 2 + "</b>\n\t tail &lt;x&gt;<ul><li>one " + words + "<li>two " + words + "</ul></article><footer>&copy; me</footer>"
    )
    text = html_text.texts_of([source], model)[0]
    line = words.strip()
    assert text == "\n".join(["Head & line", " ".join([line] * 3), "next line", f"{line} {line} tail <x>", f"one {line}", f"two {line}"])


def test_odd_pages(llm_spark, model):
    deep = "<div>" * 5_000 + "<p>" + "deep text, " * 20 + "</p>" + "</div>" * 5_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "only &eacute; text "), (4, "u", deep), (None, "u", "<a href='x"), (5, "u", '<p class="a>' * 2_000), (3, "u", "only &eacute; text ")]
    frame = llm_spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.main_text(frame, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by_id = {r["page_id"]: r["text"] for r in found}
    assert by_id[1] == by_id[2] == "" and by_id[3] == html.unescape("only &eacute; text")
    assert html_text.main_text(frame.where("false"), model).count() == 0


def test_a_rejected_node_rejects_what_is_below(model):
    page = html_text.parse('<article><p>in</p><div class="comments"><p>out</p></div></article>')
    chance = np.array([0.5, 0.95, 0.95, 0.05, 0.9])
    assert html_text.decode(page, chance).tolist() == [False, True, True, False, False]


def test_slices_are_bounded():
    assert list(slices(np.array([3, 3, 9, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices(np.array([], int), 6)) == []


def test_article_directly_in_the_body():
    text = "A long article stands in the body itself, as old pages do, and says something in every sentence. It goes on for a while."
    menu = "<div class=menu><ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul></div>"
    model = html_text.train(None)
    page = f"<body>{menu}{text}<br>{text} more <b>bold</b> text.<p>{text}</p>{text}</body>"
    assert html_text.texts_of([page], model) == ["\n".join([text, f"{text} more bold text.", text, text])]
    assert html_text.texts_of(["just text"], model) == ["just text"]


def test_inline_elements_follow_their_block():
    page = html_text.parse('<article><p>in <a href=/x>a link</a> and <em>more</em></p></article><nav><p>out <a href=/y>y</a></p></nav>')
    chance = np.array([0.5, 0.95, 0.95, 0.05, 0.05, 0.05, 0.05, 0.95])
    assert html_text.decode(page, chance).tolist() == [False, True, True, True, True, False, False, False]


def whole(source):
    page = html_text.parse(source)
    return html_text.text_of(page, np.ones(len(page.tags), bool))


def test_unclosed_elements_lose_no_text():
    for tag in sorted(html_text.HIDDEN):
        assert whole(f"<article><p>first<{tag}>gone<p>second</article><div>third</div>") == "first\nsecond\nthird"
        assert whole(f"<div>a<{tag}><p>gone</{tag}>b</div><div>c<{tag}>gone</div>d") == "ab\nc\nd"
        assert whole(f"<p>a<{tag}>gone<p>b</p><p>c<{tag}>gone</{tag}>d</p>") == "a\nb\ncd"
    for tag in sorted(html_text.RAW):
        assert whole(f"<p>a<{tag}>gone</{tag}>b</p><p>c<{tag}>gone<p>gone") == "ab\nc"
    assert whole("<p>a</p><!-- gone <p>gone</p>") == "a"
    assert whole('<p>a</p><p class="x>b</p><p>c</p>') == "a\nb\nc"
    assert whole("a < b <c") == "a < b <c"


def test_references_of_any_length():
    assert whole("a &#" + "9" * 6_000 + "; &#x" + "F" * 6_000 + "; &#" + "0" * 6_000 + "65; &#x00041; &#0; &#") == "a \ufffd \ufffd A A \ufffd &#"


def test_broken_pages_take_time_in_proportion():
    """A megabyte of each; one that were quadratic would take hours."""
    import time

    pieces = ["<! ", "<a ", "<b>", "<h2>", '<a "x>" ', "<select>", "<!-- ", "<td>", "<p><object>", "</i>", "<i><div></i>", "&#", '"<']
    pages = [piece * (1_000_000 // len(piece)) for piece in pieces]
    pages += ["<b>" * 150_000 + "</i>" * 150_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 150_000, "<dl>" + "<h3>" * 100_000 + "<dt>" * 100_000]
    for page in pages:
        start = time.process_time()
        whole(page)
        assert time.process_time() - start < 30, page[:40]
