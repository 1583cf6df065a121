import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomspan.sources.http import Manner, failures, fetched, land, numbered_pages

ASKED, AGENTS = Counter(), set()
QUICK = Manner(agent="tester", timeout=1.0, step=0.01)


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        ASKED[self.path] += 1
        AGENTS.add(self.headers["User-Agent"])
        n = int(self.path.rsplit("/", 1)[-1])
        if self.path.startswith("/flaky") and ASKED[self.path] <= 2 or n == 7 or self.path.startswith("/later") and not ASKED["open"]:
            self.send_error(404 if n == 7 else 503)
            return
        if n == 8:
            time.sleep(3)
        body = f"<p>page {n} é</p>".encode("latin-1" if n == 5 else "utf-8")
        self.send_response(200)
        self.send_header("Content-Type", "text/html" + ("; charset=latin-1" if n == 5 else ""))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_numbered_pages_that_fail_twice_come(spark, site):
    df = numbered_pages(spark, site + "/flaky/{}", 6, pagesPerPartition=2, agent="tester", step=0.01)
    rows = sorted(df.collect(), key=lambda r: r.url)
    assert [(r.status, r.html, r.error, r.attempts) for r in rows] == [(200, f"<p>page {n} é</p>", None, 3) for n in range(1, 7)]
    assert df.rdd.getNumPartitions() == 3 and all(ASKED[f"/flaky/{n}"] == 3 for n in range(1, 7)) and AGENTS == {"tester"}


def test_errors_are_rows(spark, site):
    urls = spark.createDataFrame([(f"{site}/x/{n}",) for n in (1, 1, 7, 8)] + [(None,), ("http://127.0.0.1:9/none/1",), ("no address",)], "url string")
    got = {r.url.rsplit("/", 1)[-1] if site in r.url else r.url: r for r in fetched(urls, QUICK).collect()}
    assert len(got) == 5 and got["1"].status == 200 and (got["7"].status, got["7"].error, got["7"].attempts) == (404, "HTTP 404", 3)
    for bad in ("8", "http://127.0.0.1:9/none/1", "no address"):
        assert got[bad].status is None and got[bad].html is None and got[bad].error and got[bad].attempts == 3
    assert ASKED["/x/1"] == 1 and ASKED["/x/8"] == 3
    assert failures(fetched(urls.where("url like '%/7'"), QUICK)).count() == 1


def test_a_second_run_asks_only_for_what_failed(spark, site, tmp_path):
    folder = str(tmp_path / "landed")
    urls = spark.createDataFrame([(f"{site}/later/{n}",) for n in (1, 2)] + [(f"{site}/now/{n}",) for n in (3, 4)], "address string")
    first = land(urls, folder, QUICK, "address")
    assert sorted((r.url.removeprefix(site), r.error) for r in first.collect()) == [("/later/1", "HTTP 503"), ("/later/2", "HTTP 503"), ("/now/3", None), ("/now/4", None)]
    ASKED["open"] = 1
    again = land(urls, folder, QUICK, "address")
    assert failures(again).count() == 0 and again.count() == 4
    assert [ASKED[p] for p in ("/now/3", "/now/4", "/later/1", "/later/2")] == [1, 1, 4, 4]
    land(urls, folder, QUICK, "address").collect()
    assert [ASKED[p] for p in ("/now/3", "/later/1")] == [1, 4]


def test_refused_options(spark):
    with pytest.raises(ValueError):
        Manner(attempts=0)
    with pytest.raises(Exception, match="number stands"):
        numbered_pages(spark, "http://127.0.0.1/none", 3).collect()
