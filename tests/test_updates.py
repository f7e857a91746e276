import json
import threading
import urllib.request

import pytest

from quillion import cli, http_api
from quillion.search_index import SearchIndex
from quillion.sources import documents as src
from quillion.streaming.ingest import ingest

from .corpora import naive, random_docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "id string, title string, body string")


def found(index, query, k=10):
    return [(r.score, r.id) for r in index.search(query, k).orderBy("rank").collect()]


def test_segments_deletes_and_merge(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    a, b = random_docs(120, 50, 1, "a", True), random_docs(90, 50, 2, "b", True)
    index = SearchIndex.create(spark, path)
    with pytest.raises(ValueError, match="no documents"):
        index.add(frame(spark, []))
    index.add(frame(spark, a).repartition(1))
    index.add(frame(spark, b).repartition(1))
    dead = ["a-13", "a-100", "b-5", "b-89"]
    assert index.delete(*dead) == 4 and index.delete("a-13") == 0 and index.delete("zzz") == 0
    for query in ("w1 w2", "w30", "title w4 w5 w6 w7"):
        got, want = found(index, query), naive(a + b, query, 10, 2, dead)
        assert [s for s, _ in got] == [s for s, _ in want] and not {d for _, d in got} & set(dead)
    assert [(r.num_docs, r.live_docs) for r in index.segments().orderBy("segment").collect()] == [(120, 118), (90, 88)]
    index = SearchIndex.open(spark, path)
    index.merge()
    rest = [d for d in a + b if d[0] not in dead]
    assert index.stats()["num_docs"] == len(rest) and index.stats()["num_segments"] == 1
    assert [s for s, _ in found(index, "w1 w2")] == [s for s, _ in naive(rest, "w1 w2", 10, 2)]
    index.update(frame(spark, [("a-1", "", "zzzuniqueterm")]))
    assert [d for _, d in found(index, "zzzuniqueterm")] == ["a-1"] and index.find("a-1").count() == 1
    index.merge()
    out = index.run_pruned("w1 w2", 10)
    assert [r.score for r in out.results] == [s for s, _ in found(index, "w1 w2")] and out.counters.docs_total == len(rest)
    assert index.rebuild_stats()


def test_upsert_counts(spark, tmp_path):
    docs = random_docs(60, 30, 21, "u")
    index = SearchIndex.create(spark, f"file://{tmp_path}/u")
    assert index.upsert(frame(spark, docs)) == (60, 0, 0)
    assert index.upsert(frame(spark, docs)) == (0, 0, 60) and len(index.manifest["segments"]) == 1
    changed = [("u-0", "", "quite new"), *docs[1:], ("u-new", "", "added later")]
    assert index.upsert(frame(spark, changed)) == (1, 1, 59)
    index.merge()
    assert index.upsert(frame(spark, changed)) == (0, 0, 61)
    assert index.upsert(frame(spark, [("t", "x", "1"), ("t", "x", "2")])) == (2, 0, 0)
    assert index.delete("t") == 1 and index.delete("t") == 1 and index.delete("t") == 0


def test_missing_and_existing_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SearchIndex.open(spark, f"file://{tmp_path}/none")
    first = SearchIndex.create(spark, f"file://{tmp_path}/i", title_weight=5)
    assert SearchIndex.create(spark, f"file://{tmp_path}/i", title_weight=1).manifest["title_weight"] == 5 and first.search("x").count() == 0


def test_orders_and_command_line(spark, tmp_path, capsys):
    docs = random_docs(70, 30, 5, "c", True)
    lines = "\n".join(json.dumps({"id": i, "title": t, "body": b, "more": 1}) for i, t, b in docs) + "\n\n"
    (tmp_path / "in.jsonl").write_text(lines)
    (tmp_path / "q.txt").write_text(" w1 w2 \n\nw3\n")
    want = [s for s, _ in naive(docs, "w1 w2", 5, 2)]
    for order in ("none", "path"):
        path = f"file://{tmp_path}/{order}"
        assert cli.main(["index", "--index", path, "--input", str(tmp_path / "in.jsonl"), "--order", order], spark) == 0
        assert [s for s, _ in found(SearchIndex.open(spark, path), "w1 w2", 5)] == want
    assert cli.main(["search", "--index", path, "--query", "w1 w2", "--top-k", "3", "--url", "http://x/{id}"], spark) == 0
    assert "3 results" in capsys.readouterr().out
    assert cli.main(["add", "--index", path, "--input", str(tmp_path / "in.jsonl"), "--upsert"], spark) == 0
    assert "added 0, updated 0, unchanged 70" in capsys.readouterr().out
    assert cli.main(["delete", "--index", path, "--id", "c-3"], spark) == 0 and cli.main(["delete", "--index", path, "--id", "c-3"], spark) == 1
    assert cli.main(["bench", "--index", path, "--queries", str(tmp_path / "q.txt")], spark) == 0
    assert "p95_ms" in capsys.readouterr().out
    assert cli.link("u", "t", False) == "t" and "8;;u" in cli.link("u", "t", True)


def test_http(spark, tmp_path):
    index = SearchIndex.build(spark, frame(spark, random_docs(30, 20, 8, "h")), f"file://{tmp_path}/h")
    httpd = http_api.server(index, "127.0.0.1:0")
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{httpd.server_port}{p}"))
    body = get("/search?q=w1+w2&k=4")
    assert len(body["results"]) == 4 and body["docs_total"] == 30 and body["query_terms"] == 2
    assert body["docs_scored"] <= 30 and body["postings_visited"] >= body["docs_scored"] and body["blocks_visited"] == 2 and body["blocks_skipped"] == 0
    assert get("/stats")["num_docs"] == 30
    httpd.shutdown()
    assert http_api.answer(index, "/nothing")[0] == 404 and http_api.answer(index, "/search")[0] == 400 and http_api.answer(index, "/search?q=a&k=x")[0] == 400


def test_load(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(http_api, "answer", lambda index, target: (200 if "good" in target else 400, {}))
    httpd = http_api.server(None, "127.0.0.1:0")
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    addr = f"127.0.0.1:{httpd.server_address[1]}"
    got = http_api.load(addr, ["good one", "bad"], connections=2, seconds=0.5)
    httpd.shutdown()
    assert got["requests"] > 0 and got["errors"] > 0 and got["p50_ms"] <= got["p99_ms"]
    with pytest.raises(ValueError):
        http_api.load(addr, [])


def test_stream(spark, tmp_path):
    docs = random_docs(20, 20, 4, "s")
    (tmp_path / "in").mkdir()
    line = lambda part: "\n".join(json.dumps({"id": i, "title": t, "body": b}) for i, t, b in part)
    (tmp_path / "in" / "1.json").write_text(line(docs))
    run = lambda: ingest(src.stream_jsonl(spark, str(tmp_path / "in")), f"file://{tmp_path}/x", str(tmp_path / "ck")).awaitTermination(120)
    run()
    (tmp_path / "in" / "2.json").write_text(line([*docs[:5], ("s-0", "", "changed"), ("s-99", "", "more")]))
    run()
    index = SearchIndex.open(spark, f"file://{tmp_path}/x")
    assert index.stats()["num_docs"] >= 21 and [d for _, d in found(index, "changed")] == ["s-0"]


def test_sources(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "title": "t"}\n')
    with pytest.raises(Exception, match="no body"):
        src.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "broken.jsonl").write_text('{"id": "1", \n')
    with pytest.raises(Exception):
        src.read_jsonl(spark, str(tmp_path / "broken.jsonl")).collect()
    assert src.parse_jsonl(spark, ['{"id":"1","title":"t","body":"b"}', " "]).count() == 1
    (tmp_path / "none.txt").write_text("\n \n")
    with pytest.raises(ValueError, match="no query"):
        src.read_queries(spark, str(tmp_path / "none.txt"))
    dump = ['{"index":{"_id":"7"}}', '{"title":"A","text":"x"}', '{"title":"B","text":"y"}', "broken", '{"index":{"_id":"9"}}', '{"title":"","text":"z"}', '{"title":"C","text":"w"}']
    (tmp_path / "dump.json").write_text("\n".join(dump))
    rows = [(r.id, r.title, r.body) for r in src.wiki_dump(spark, str(tmp_path / "dump.json")).collect()]
    assert rows == [("7", "A", "x"), ("doc-1", "B", "y"), ("doc-2", "C", "w")]
    assert src.wiki_dump(spark, str(tmp_path / "dump.json"), limit=1).count() == 1
    tree = tmp_path / "tree"
    for name, data in {"a.md": b"hello", "b.bin": b"x", "node_modules/c.md": b"no", "sub/d.py": b"print(1)", "e.txt": b"\xff\xfe", "f.txt": b"  ", "g.txt": b"y" * 300}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    rows = sorted((r.title, r.body) for r in src.read_folder(spark, str(tree), max_bytes=250).collect())
    assert rows == [("a.md", "hello"), ("sub/d.py", "print(1)")]
    titles = spark.createDataFrame([(0, "The Big Red House on Hill"), (1, "skipped"), (2, "one two three"), (4, "an extraordinary thing"), (6, "to of"), (8, "solo")], "doc_id long, title string")
    assert [r["query"] for r in src.sample_queries(titles, every=2).orderBy("doc_id").collect()] == ["big red house hill", "one two", "extraordinary", "solo"]


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/c"
    index = SearchIndex.build(spark, frame(spark, random_docs(30, 20, 3, "c")), path)
    want = found(index, "w1 w2")

    def die(*args):
        raise OSError("killed")

    for step in ("write_once", "remove"):
        broken = SearchIndex.open(spark, path)
        with monkeypatch.context() as m:
            m.setattr("quillion.sources.tables." + step, die)
            try:
                broken.upsert(frame(spark, [("new", "", "zzz")])) if step == "write_once" else broken.merge()
            except OSError:
                pass
        again = SearchIndex.create(spark, path)
        assert again.stats()["num_docs"] == 30 and found(again, "w1 w2") == want
    assert again.upsert(frame(spark, [("new", "", "zzz")])) == (1, 0, 0) and SearchIndex.open(spark, path).stats()["num_docs"] == 31
    with pytest.raises(FileExistsError, match="another writer"):
        broken.add(frame(spark, [("late", "", "yyy")]))
    for f in (tmp_path / "c").glob("manifest-*"):
        f.unlink()
    with pytest.raises(FileExistsError, match="no manifest"):
        SearchIndex.create(spark, path)


def test_searches_read_stored_statistics(spark, tmp_path):
    index = SearchIndex.build(spark, frame(spark, random_docs(40, 20, 3, "s")), f"file://{tmp_path}/s")
    index.add(frame(spark, random_docs(30, 20, 4, "t")))
    index.delete("s-3", "t-4")
    asked = spark.createDataFrame([(1, "w1 w2")], "query_id int, query string")
    docs = random_docs(40, 20, 3, "s") + random_docs(30, 20, 4, "t")
    want = [s for s, _ in naive(docs, "w1 w2", 10, 2, ["s-3", "t-4"])]
    assert [r.score for r in index.search_batch(asked).orderBy("rank").collect()] == want == [s for s, _ in found(index, "w1 w2")]
    plan = index.search("w1 w2")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "tf:bigint" in x.partition("ReadSchema")[2]]
    assert len(scans) == 1 and "In(term, [" in scans[0]
    assert index.rebuild_stats().keys() == {"seg-000000", "seg-000001"} and index.stats()["num_docs"] == 68


def test_stream_of_incomplete_documents_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"title": "no id"}\n')
    query = ingest(src.stream_jsonl(spark, str(tmp_path / "in")), f"file://{tmp_path}/x", str(tmp_path / "ck"))
    with pytest.raises(Exception, match="no id|no body"):
        query.awaitTermination(120)
