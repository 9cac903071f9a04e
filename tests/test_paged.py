"""Pages of records: whole batches, and streams that go on where they ended."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest

from townhall.sources import paged as P


def land(folder, total, held, limit=10):
    for page in range(-(-held // limit)):
        (folder / f"page={page}").mkdir(parents=True, exist_ok=True)
        records = [{"k": n, "name": f"é{n}"} for n in range(page * limit, min(held, (page + 1) * limit))]
        (folder / f"page={page}" / "part-0.json").write_text(json.dumps({"total": total, "records": records}))


def keys(rows):
    return sorted((r["number"], json.loads(r["record"])["k"]) for r in rows)


def test_batch(spark, tmp_path):
    P.register(spark)
    read = lambda: spark.read.format("paged").option("limit", 10).load(f"file://{tmp_path}/page={{page}}")
    assert read().count() == 0  # nothing has landed
    land(tmp_path, 0, 1)
    assert read().count() == 0
    land(tmp_path, 37, 37)
    assert keys(read().collect()) == [(n, n) for n in range(37)] and read().rdd.getNumPartitions() == 4
    land(tmp_path, 41, 37)
    with pytest.raises(Exception, match="page 3 has 7 records|page 4 has 0 records"):
        read().count()


def test_stream_goes_on(spark, tmp_path):
    """The total grows in the middle of a page, and a page that is missing ends a run: no record is lost or comes twice."""
    P.register(spark)
    pages, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("paged").option("limit", 10).load(f"{pages}/page={{page}}")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def got():
        return keys(spark.read.parquet(out).collect())

    land(pages, 25, 25)
    run()
    assert got() == [(n, n) for n in range(25)]
    land(pages, 37, 37)
    run()
    run()  # nothing new
    assert got() == [(n, n) for n in range(37)]
    land(pages, 55, 45)
    with pytest.raises(Exception, match="page 4 has 5 records|page 5 has 0 records"):
        run()
    assert got() == [(n, n) for n in range(37)]
    land(pages, 55, 55)
    run()
    assert got() == [(n, n) for n in range(55)]


def test_addresses(spark):
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            first, limit = int(q["offset"][0]), int(q["limit"][0])
            body = json.dumps({"total": 23, "records": [{"k": n} for n in range(first, min(23, first + limit))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        P.register(spark)
        address = f"http://127.0.0.1:{server.server_port}/r?limit={{limit}}&offset={{offset}}"
        assert keys(spark.read.format("paged").option("limit", 7).load(address).collect()) == [(n, n) for n in range(23)]
    finally:
        server.shutdown()
