"""The data source of changed records, against a local server."""

import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from palimpsest.sources.delta import DeltaSource, dealt

D = date.fromisoformat
RECORDS = [{"id": i, "day": (D("2024-01-01") + timedelta(i % 40)).isoformat(), "contact": "x", "in": [{"contact": "y", "k": i}]} for i in range(130)]


class Server(BaseHTTPRequestHandler):
    last, wrong, busy, asked = "2024-02-09", False, 0, []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if Server.busy > 0:
            Server.busy -= 1
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if self.path.startswith("/version"):
            out = {"dataTimestamp": Server.last + "T00:00:00"}
        else:
            Server.asked.append((q["since"], q["until"]))
            found = [r for r in RECORDS if q["since"] <= r["day"] <= min(q["until"], Server.last)]
            at = int(q.get("pageToken", 0))
            size = int(q["pageSize"])
            out = {"studies": found[at : at + size], **({"totalCount": len(found) + Server.wrong} if at == 0 else {}), **({"nextPageToken": str(at + size)} if at + size < len(found) else {})}
        body = json.dumps(out).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def url(spark):
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(DeltaSource)
    Server.last, Server.wrong, Server.busy = "2024-02-09", False, 0
    Server.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ids(rows):
    return sorted(json.loads(r.raw)["id"] for r in rows.collect())


def test_days_are_dealt():
    days = dealt(D("2024-01-01"), D("2024-01-10"), 4)
    assert [(d.since.day, d.until.day) for d in days] == [(1, 2), (3, 5), (6, 7), (8, 10)]
    assert dealt(D("2024-01-02"), D("2024-01-01"), 4) == [] and len(dealt(D("2024-01-01"), D("2024-01-02"), 8)) == 2


def test_a_range_is_read_in_partitions_and_pages(spark, url):
    options = dict(url=f"{url}/studies", since="2024-01-05", until="2024-01-30", slices=3, pageSize=7, privateKeys="contact", waitSeconds="0.01")
    Server.busy = 2
    rows = spark.read.format("deltas").options(**options).load()
    assert ids(rows) == [r["id"] for r in RECORDS if "2024-01-05" <= r["day"] <= "2024-01-30"]
    assert rows.rdd.getNumPartitions() == 3 and not rows.filter("raw like '%contact%'").count()


def test_another_number_than_announced_fails(spark, url):
    Server.wrong = True
    with pytest.raises(Exception, match="announced"):
        spark.read.format("deltas").options(url=f"{url}/studies", since="2024-01-05", until="2024-01-06", waitSeconds="0.01").load().count()


def test_a_stream_goes_on_where_it_ended(spark, url, tmp_path):
    def run():
        stream = spark.readStream.format("deltas").options(url=f"{url}/studies", versionUrl=f"{url}/version", since="2024-01-01", slices=2, pageSize=50, overlap=1).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()

    Server.last = "2024-01-10"
    run()
    assert ids(spark.read.parquet(f"{tmp_path}/out")) == [r["id"] for r in RECORDS if r["day"] <= "2024-01-10"]
    Server.last = "2024-01-20"
    Server.asked.clear()
    run()
    assert min(a for a, _ in Server.asked) == "2024-01-10"  # one day of overlap
    assert sorted(set(ids(spark.read.parquet(f"{tmp_path}/out")))) == [r["id"] for r in RECORDS if r["day"] <= "2024-01-20"]
