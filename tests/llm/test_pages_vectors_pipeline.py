"""Archives, neighbours, the registered queries and the pipeline."""

import base64
import gzip
import hashlib
import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from compare import duck, duck_result, spark_result
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from curbside.llm import neighbours, queries, warc
from curbside.llm.common import materialise, scratch_path

from .conftest import documents

# ------------------------------------------------------------------ archives


def archives_by_hand(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    largest = {}
    for i, p in payloads:
        if i is not None and len(p) >= 1000:
            largest[p] = max(largest.get(p, i), i)
    out = []
    for i, p in payloads:
        refers = largest.get(p)
        refers = refers if i is not None and refers is not None and refers > i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd_pages(spark):
    big, edge = "<p>é</p>" * 300, "x" * 999
    rows = [(1, "http://a.b/c?d", big), (2, None, big), (-3, "bad url\r\nX: y", big), (4, "u", edge),
            (5, "u", edge), (6, "u", None), (7, "u", ""), (None, "u", big), (2, None, big),
            (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    return spark.createDataFrame(
        [(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string")


@pytest.mark.parametrize("package", [2000, warc.PACKAGE])
def test_archives(spark, table, odd_pages, package):
    pages = table("pages").unionByName(odd_pages, allowMissingColumns=True)
    packages = warc.write_archives(pages, scratch_path(spark, "a"), package_bytes=package)
    index = warc.read_index(packages)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert index.count() == len(rows) == packages.agg(F.sum("records")).first()[0]
    found = warc.read_records(index)
    mine = [tuple(r) for r in found.drop("url", "payload").collect()]
    assert sorted(mine, key=repr) == archives_by_hand(rows)
    html = {(i, (h or "").encode()) for i, _, h in rows}
    stored = found.filter("payload is not null").select("page_id", "payload").collect()
    assert {(r.page_id, bytes(r.payload)) for r in stored} <= html
    one = index.filter(F.col("url_key") == "b,a)/c?d")
    assert [r.page_id for r in warc.read_records(one).collect()] == [1]


def test_other_tools_read_the_packages(spark, odd_pages):
    packages = warc.write_archives(odd_pages.coalesce(1), scratch_path(spark, "a"))
    path = packages.first().path.removeprefix("file:")
    with zipfile.ZipFile("/" + path.lstrip("/")) as z:
        assert z.testzip() is None
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        text = gzip.decompress(z.read("archive/data.warc.gz"))
        assert text.count(b"WARC/1.1\r\nWARC-Type") == odd_pages.count()
        lines = z.read("indexes/index.cdxj").decode().splitlines()
        assert lines == sorted(lines) and len(lines) == odd_pages.count()


def test_odd_urls_lose_no_page(spark):
    breaks = [chr(c) for c in (*range(32), 0x7F, 0x85, 0xA0, 0x2028, 0x2029, 0x3000) if c not in (10, 13)]
    urls = ["http://[bad/x", "http://[bad/\u2028 y", "http://bad]/x", "http://[::1]/x", "http://a\u2100b.c/x",
            "http://[", "http://a:port/x", "//", "?", "\ud7ff", "http://a.b/c?d e\x85f"]
    urls += [f"http://a.b/{c}x{c}" for c in breaks] + [f"http://[bad{c}" for c in breaks]
    pages = spark.createDataFrame(
        [(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    packages = warc.write_archives(pages.coalesce(1), scratch_path(spark, "a"))
    index = warc.read_index(packages)
    found = warc.read_records(index).collect()
    assert {r.page_id: (r.url, r.payload.decode()) for r in found} == {
        i: (u, f"page {i}") for i, u in enumerate(urls)}
    assert len(found) == len(urls)
    one = index.filter(F.col("url_key") == "http://[bad/x")
    assert [r.page_id for r in warc.read_records(one).collect()] == [0]
    path = packages.first().path.removeprefix("file:")
    with zipfile.ZipFile("/" + path.lstrip("/")) as z:
        lines = z.read("indexes/index.cdxj").decode().splitlines()
    assert len(lines) == len(urls) and all(x.split(" ", 2)[2].startswith("{") for x in lines)
    assert warc.url_key("http://a.b/\u2028x y\x85") == "b,a)/%e2%80%a8x%20y%c2%85"


def test_no_pages(spark, odd_pages):
    packages = warc.write_archives(odd_pages.limit(0), scratch_path(spark, "a"))
    assert warc.read_records(warc.read_index(packages)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_directories(tmp_path, wide, monkeypatch):
    """Both plain and ZIP64 directories, with a comment behind."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = {f"m{i}": bytes([i]) * (20 + i) for i in range(5)}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        for name, content in data.items():
            z.writestr(name, content)
        z.comment = b"a comment"
    raw = buffer.getvalue()
    assert (b"PK\x06\x07" in raw) == wide
    found = warc.directory(pa.BufferReader(raw))
    assert {n: raw[a : a + size] for n, (a, size) in found.items()} == data


def test_damage_is_found():
    payload = b"hello" * 300
    data = warc.record(7, "http://x/", payload, hashlib.sha1(payload).digest(), None)
    assert warc.parse(data)["payload"] == payload
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"hellohello", b"hellOhello", 1))
    assert base64.b32encode(hashlib.sha1(payload).digest()) in data


def _foreign(path, deflated=False, index="indexes/index.cdx.gz", filename=True):
    """A package as others write it: deflated side files, two archives, random record ids."""
    import gzip
    import json
    import uuid
    import zipfile

    archives, lines, want = {"a.warc.gz": b"", "b.warc.gz": b""}, [], {}
    for i in range(300):
        name = "a.warc.gz" if i % 3 or not filename else "b.warc.gz"
        body = f"<p>page {i}</p>".encode() * (i % 40)
        http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
        head = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\n"
                f"WARC-Target-URI: http://e.org/{i}\r\nContent-Type: application/http;msgtype=response\r\n"
                f"Content-Length: {len(http)}\r\n\r\n").encode()
        packed = gzip.compress(head + http + b"\r\n\r\n")
        place = {"offset": str(len(archives[name])), "length": str(len(packed)), "mime": "text/html"}
        if filename:
            place["filename"] = name
        lines.append(f"org,e)/{i} 20240101000000 {json.dumps(place)}\n")
        archives[name] += packed
        want[f"http://e.org/{i}"] = body
    text = "".join(sorted(lines)).encode()
    half = len(text) // 2
    if index.endswith(".gz"):  # two gzip streams in one file
        text = gzip.compress(b"!meta 0 {}\n" + text[:half]) + gzip.compress(text[half:])
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("datapackage.json", "{}" * 500, zipfile.ZIP_DEFLATED)
        package.writestr("pages/pages.jsonl", "{}\n" * 500, zipfile.ZIP_DEFLATED)
        package.writestr(index, text, zipfile.ZIP_STORED if index.endswith(".gz") else zipfile.ZIP_DEFLATED)
        for name, data in archives.items():
            if data:
                package.writestr(f"archive/{name}", data,
                                 zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED)
    return want


@pytest.mark.parametrize(("index", "filename"), [
    ("indexes/index.cdx.gz", True), ("indexes/index.cdxj", True), ("indexes/own.cdxj", False)])
def test_packages_of_other_writers(spark, tmp_path, monkeypatch, index, filename):
    want = _foreign(tmp_path / "x.wacz", index=index, filename=filename)
    packages = spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")
    rows = warc.read_records(warc.read_index(packages)).collect()
    assert {r.url: bytes(r.payload) for r in rows} == want and len(rows) == 300
    assert all(r.page_id is None and r.record_type == "response" for r in rows)
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in rows)
    one = warc.read_index(packages).filter("url_key = 'org,e)/77'")
    assert [r.url for r in warc.read_records(one).collect()] == ["http://e.org/77"]


def test_an_index_is_read_a_piece_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 100)
    for index in ("indexes/index.cdx.gz", "indexes/index.cdxj"):
        _foreign(tmp_path / "x.wacz", index=index)
        assert len(set(warc._places(f"file://{tmp_path}/x.wacz"))) == 300


def test_archives_that_are_not_stored(tmp_path):
    _foreign(tmp_path / "x.wacz", deflated=True)
    with pytest.raises(ValueError, match="not stored"):
        list(warc._places(f"file://{tmp_path}/x.wacz"))


# ------------------------------------------------------------------ neighbours


def nearest_by_hand(rows, ask, k):
    rows = [(i, np.array(v, dtype=float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if ask(q):
            scores = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in rows if i != q)
            out[q] = scores[:k]
    return out


def test_neighbours(table):
    vectors = table("embeddings")
    found = neighbours.nearest(vectors, F.col("vec_id") % 10 == 0, block=100).collect()
    want = nearest_by_hand(
        [tuple(r) for r in vectors.select("vec_id", "embedding").collect()], lambda i: i % 10 == 0, 10)
    hits = total = 0
    for q, best in want.items():
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in best})
        total += len(best)
    assert hits >= 0.99 * total


def recall(found, want, k=10):
    """Share of the true neighbours found; ranks and order are checked on the way."""
    hits = total = 0
    for q, best in want.items():
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(best) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        # By distance: rows of one id can't be told apart by it.
        hits += sum(r.score <= best[-1][0] * (1 + 1e-12) for r in mine)
        total += len(best)
    assert len({r.query_id for r in found}) == len([b for b in want.values() if b])
    return hits / total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_registered_query(spark, table, sf):
    vectors = table("embeddings", sf)
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding").collect()]
    want = nearest_by_hand(rows, lambda i: i % 100 == 0, 10)
    found = queries.op7_neighbours(spark, f"/root/testdata/{sf}").collect()
    assert recall(found, want) >= 0.99


def test_a_query_that_repeats(spark):
    """All ten neighbours, though 30 nearer rows have the query's own id."""
    rng = np.random.default_rng(5)
    rows = [(0, rng.standard_normal(16) * 0.01 + 1) for _ in range(30)]
    rows += [(i, rng.standard_normal(16)) for i in range(1, 400)]
    rows = [(i, v.tolist()) for i, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cells, block in ((256, 16384), (4, 40), (1, 7)):
        found = neighbours.nearest(
            vectors, F.col("vec_id") == 0, cells=cells, block=block).collect()
        asker = min(v for i, v in rows if i == 0)
        best = sorted((float(np.sqrt(((np.array(v) - asker) ** 2).sum())), i)
                      for i, v in rows if i)[:10]
        assert [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == best


def test_cells_cost_no_neighbours(spark):
    """Clusters of very different sizes, one vector that a third of the rows share."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 24)) * 4
    x = centres[rng.integers(0, 12, 3000) % rng.integers(1, 13, 3000)] + rng.standard_normal((3000, 24)) * 0.3
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0, block=200).collect()
    assert recall(found, nearest_by_hand(rows, lambda i: i % 50 == 0, 10)) >= 0.99


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]),
            (10, [5.0, 5.0]), (10, [5.0, 5.0]), (100, [4.0, 4.0])]
    vectors = spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<float>, vector string")
    found = neighbours.nearest(vectors, F.col("vec_id") % 10 == 0, k=3).collect()
    mine = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
            for q in (0, 10, 100)}
    assert mine == {0: [1, 2, 100], 10: [100, 0, 1], 100: [10, 10, 0]}
    assert len(found) == 9
    assert neighbours.nearest(vectors.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal((20, 64))
    centre, turn = x.mean(axis=0), neighbours.rotation(64, 3)
    low, high = neighbours.bounds(*neighbours.encode(x, centre, turn), q, centre, turn, 3.0)
    true = ((x[:, None] - q[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.99


# ------------------------------------------------------------------ queries and pipeline


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, sf_small, name):
    ours = spark_result(queries.QUERIES[name](spark, sf_small))
    assert ours == duck_result(duck(sf_small), queries.ORACLE_SQL[name])


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_queries_return_a_row_for_each_document(spark, sf_small, name, table):
    rows = queries.QUERIES[name](spark, sf_small)
    if "doc_id" in rows.columns and name != "op12_packing":  # a row for each piece
        assert rows.count() == table("documents").count()
    else:
        assert rows.count() > 0


def test_native_queries_run_no_python(spark, sf_small):
    for name in ("op4_decontaminate", "op8_pii"):
        plan = queries.QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct"))


def test_pipeline(spark, sf_small, table):
    """Each stage's decisions, recomputed from what its predecessor kept."""
    from .test_text_operators import base_by_hand, groups_by_hand, hits_by_hand

    docs = table("documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "pieces"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf_small), name))
        if name != "pieces":
            assert kept[-1].columns == docs.columns
    text = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in kept[:-1]]
    assert 0 < len(text[1]) <= len(text[0])
    groups = groups_by_hand(list(text[1].items()), 5, 80)
    assert set(text[2]) == {i for i, (_, _, first) in groups.items() if first}
    items = [tuple(r) for r in table("benchmark").collect()]
    clean = {i for i, *_, hit in hits_by_hand(list(text[2].items()), items) if not hit}
    assert set(text[3]) == clean == set(text[4])
    assert not any(base_by_hand(t) for t in text[4].values())
    pieces = {r.doc_id: r.pieces for r in kept[-1].collect()}
    assert set(pieces) == clean
    ran = {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert ran == pieces


def test_one_bad_row_of_an_id(spark):
    """Verdicts are on rows: the other texts of the id stay, a null id's rows all do."""
    rows = [(1, "bad"), (1, "good"), (2, "bad"), (None, "bad"), (3, None), (1, "bad")]
    docs = documents(spark, rows)
    key = F.xxhash64("doc_id", "text").alias("row")
    verdicts = docs.select("doc_id", key, (F.col("doc_id").eqNullSafe(1) & (F.col("text") == "bad") | F.col(
        "doc_id").isNull()).alias("gone")).selectExpr("doc_id", "row", "not coalesce(gone, false) as kept")
    left = corpus_pipeline._kept(docs, verdicts)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(1, "good"), (2, "bad"), (None, "bad"), (3, None)], key=repr)


def test_pipeline_on_odd_and_empty_tables(spark, odd_documents, no_documents, table, tmp_path):
    root = f"file://{tmp_path}"
    for name in ("labels", "benchmark"):
        table(name).write.parquet(f"{root}/{name}.parquet")
    for docs in (documents(spark, [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]),
                 no_documents):
        docs = docs.withColumn("n_chars", F.length("text"))
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, root), name)
        # Copies are gone, but for those of texts without words, which are linked with nothing.
        assert {r.doc_id for r in docs.filter("doc_id >= 100").collect()} <= {100, 101, 102, 103}
