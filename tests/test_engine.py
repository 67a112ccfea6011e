import datetime as dt
import io
import os
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from corvane.errors import CODES, CorvaneError
from corvane.plans import cli, render, tools
from corvane.plans.engine import Engine
from corvane.sources import store
from corvane.sources.store import Store
from corvane.streaming import watch
from tests.test_operators import CODE, PY


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in [*CODE, ("app/long.py", PY), ("app/login.py", "def login_user(name):\n    '''Check the password of a user and open a session.'''\n    return session_for(name, password=None)\n")]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content or "# nothing\n")
    return Engine.over(spark, str(root), str(tmp_path_factory.mktemp("store") / "ix")), root


def test_index_is_brought_up_to_date(engine, spark):
    e, root = engine
    assert e.index()["status"] == "rebuilt" and e.index() == {"status": "up_to_date", "chunks": 0}
    (root / "app/new.py").write_text("def brand_new_function():\n    return 'words that are only in the new file'\n")
    fresh = Engine.over(spark, str(root), e.store.root)
    assert fresh.index()["status"] == "updated"
    assert fresh.search("brand_new_function").first()["file_path"] == "app/new.py"
    (root / "app/blob.py").write_bytes(b"a\x00b")
    assert Engine.over(spark, str(root), e.store.root).index() == {"status": "updated", "chunks": 0}
    assert Engine.over(spark, str(root), e.store.root).index() == {"status": "up_to_date", "chunks": 0}
    os.remove(root / "app/blob.py")
    os.remove(root / "app/new.py")
    again = Engine.over(spark, str(root), e.store.root)
    assert again.index() == {"status": "updated", "chunks": 0} and again.grep("only in the new file").count() == 0
    whole = {tuple(r) for r in again.store.read("chunks").select("id", "content").collect()}
    again.index(force=True)
    assert {tuple(r) for r in again.store.read("chunks").select("id", "content").collect()} == whole


def test_queries(engine):
    e, _ = engine
    assert e.search("login password", 3).first()["file_path"] == "app/login.py"
    assert e.search("login", 3, min_score=1e9).count() == 0
    assert [r.file for r in e.grep("login_user").collect()] == ["app/login.py"]
    assert [r.match for r in e.grep(r"def login_\w+", regex=True).collect()] == ["def login_user"]
    found, total = e.find("login password", 3)
    assert found.first()["name"] == "login_user" and total >= found.count()
    assert {r.node for r in e.dependencies("app/main.py", 1).collect()} >= {"app/main.py", "lib/x.py"}
    assert {r.path for r in e.impact("lib/x.py", fuzzy=False).collect()} >= {"app/main.py", "app/util.py"}
    near = {r.path: r for r in e.discover("app/main.py").collect()}
    assert near["app/main.py"].imports == ["app/__init__.py", "app/core/__init__.py", "app/core/deep.py", "lib/x.py"] and "app/main.py" in near["lib/x.py"].imported_by
    assert not {r.file_path for r in e.related("app/main.py").collect()} & set(near)
    x = e.explain("app/login.py", "LOGIN_USER")
    assert x["name"] == "login_user" and "password" in x["content"]
    p = e.probe("def mine(): pass\nlogin_user(1)\nother_thing(2)")
    assert [m["symbol"] for m in p["missing"]] == ["login_user", "other_thing"] and p["missing"][0]["file"] == "app/login.py" and p["defined"] == ["mine"]
    assert e.map("flat", files=1).count("files beyond") == 1 and e.map_lines().count() > 3
    assert "└── " in e.map() and "def login_user(name):" in e.map("flat")
    assert e.info()["files"] > 0
    with pytest.raises(CorvaneError, match="no such file"):
        e.dependencies("absent.py")
    for call in (lambda: e.search(" "), lambda: e.pack()):
        with pytest.raises(CorvaneError):
            call()


def spark_of(e):
    return e.spark


def test_packs(engine):
    e, root = engine
    assert e.inside(f"{root}/app/../app/x.py") == "app/x.py" and e.inside("./a/b") == "a/b"
    for bad in ("/etc/passwd", "../x", "a/../../x"):
        with pytest.raises(CorvaneError):
            e.inside(bad)
    p = e.pack("app/main.py", "login password", chunk_mode=True, max_chunks=2)
    assert p["files"][0]["path"] == "app/main.py" and any(c["path"] == "app/login.py" for c in p["chunks"])
    assert not {c["path"] for c in p["chunks"]} & {f["path"] for f in p["files"]}
    for form in ("xml", "chunks", "compact"):
        assert "app/login.py" in render.pack(p, form, verbose=True)
    xml.dom.minidom.parseString(render.pack(p, "xml").split("<!--")[0])
    assert render.pack(p, quiet=True).startswith("app/main.py") and "total_tokens=" in render.pack(p, quiet=True)
    files = e.pack(query="return password", max_files=1)
    assert len(files["files"]) == 1 and files["summary"]["truncated"]
    assert e.pack("app/main.py", max_tokens=60)["summary"]["returned"] == 1
    assert e.pack("app/main.py", import_depth=3)["summary"]["returned"] > e.pack("app/main.py", import_depth=1)["summary"]["returned"] - 1
    assert e.audit(query="login")[0]["path"] and e.pack("app/main.py", "login", focus_only=True)["summary"]["total_available"] == e.pack("app/main.py")["summary"]["total_available"]
    by_words = Engine(spark_of(e), e.files, e.store.root, count=lambda t: len(t.split()))
    by_words.listed, by_words.contents = e.listed, e.contents
    counted = by_words.audit(query="login")
    assert counted[0]["tokens"] == max(50 + len((root / c["path"]).read_text().split()) for c in counted) and by_words.pack(query="login", max_files=1)["summary"]["total_tokens"] < 100
    long = e.pack(query="brand words padding", skeleton=True)
    assert long["files"]


def test_commands(engine):
    e, _ = engine
    for line in ("search login", "grep login_user", "find login", "impact lib/x.py", "map", "info", "pack --query login --quiet", "discover app/main.py", "explain app/login.py", "audit --query login", "explain app/login.py --function login_user --format compact", "find login --format compact", "impact lib/x.py --format compact", "discover app/main.py --format compact", "pack --focus app/main.py --focus-only --no-rerank --skeleton"):
        text = cli.run(e, cli.parser().parse_args(line.split()))
        assert text
        if text.startswith("<") and "```" not in text and "<!--" not in text:
            xml.dom.minidom.parseString(text)


def test_tools(spark, engine, tmp_path):
    e, root = engine
    t = tools.Tools(spark, str(tmp_path))
    ask = lambda method, **given: tools.answer(t, {"jsonrpc": "2.0", "id": 1, "method": method, "params": given})
    assert {x["name"] for x in ask("tools/list")["result"]["tools"]} == set(tools.Tools.NAMES) and ask("initialize")["result"]["serverInfo"]["name"] == "corvane"
    called = lambda name, **values: ask("tools/call", name=name, arguments={"root": str(root), **values})["result"]
    assert 'status="rebuilt"' in called("index")["content"][0]["text"] and 'status="up_to_date"' in called("index")["content"][0]["text"]
    for name, values, part in (("search", {"query": "login password"}, "app/login.py"), ("grep", {"pattern": "login_user"}, "app/login.py"), ("impact", {"file": "lib/x.py"}, "app/main.py"), ("probe", {"content": "login_user(1)"}, "app/login.py"), ("audit", {"query": "login"}, "total_tokens"), ("map", {}, "login.py"), ("pack", {"focus": "app/main.py"}, "app/main.py")):
        text = called(name, **values)["content"][0]["text"]
        assert part in text
        if name not in ("map", "pack"):
            xml.dom.minidom.parseString(text)
    assert called("pack")["isError"] and "MISSING_REQUIRED" in called("pack")["content"][0]["text"] and called("search", query="x", root="/absent")["isError"]
    assert ask("tools/call", name="absent")["error"]["code"] == -32602 and ask("absent")["error"]["code"] == -32601 and tools.answer(t, {"method": "x"}) is None
    said = io.StringIO()
    tools.serve(t, io.StringIO('{"id": 1, "method": "tools/list"}\n\nnot json\n{"method": "gone"}\n'), said)
    assert len(said.getvalue().splitlines()) == 2


TABLES = ("files", "seen", "chunks", "postings", "trigrams", "imports", "edges", "stats")


def test_updates_leave_what_a_rebuild_would(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    for path, content in CODE:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text((content or "# nothing") + "\n# some words that make it long enough to be a chunk of its own\n")
    (root / "tsconfig.json").write_text('{"compilerOptions": {"paths": {"#/*": ["web/*"]}}}')
    over = lambda store: Engine.over(spark, str(root), str(tmp_path / store))
    over("a").index()
    for step in range(3):
        (root / f"app/new{step}.py").write_text(f"from . import util\n\n\ndef added_{step}():\n    return 'words of step {step}, enough of them to be kept as a chunk'\n")
        (root / "app/util.py").write_text(f"from .main import go\n\n\ndef changed_{step}():\n    return 'other words in step {step}, enough of them to be kept'\n")
        os.utime(root / "app/util.py", (2e9 + step, 2e9 + step))
        (root / "web/z.ts").write_text("import q from '#/dir/index'\n")
        if step == 1:
            os.remove(root / "app/new0.py")
        assert over("a").index()["status"] == "updated"
    assert len(over("a").store.pointer()["generations"]) == 4
    over("b").index()
    for name in TABLES:
        read = lambda store: over(store).store.read(name)  # noqa: E731, B023
        a, b = read("a"), read("b")
        columns = [c for c in sorted(b.columns) if c not in ("bucket", "first")]
        if name == "trigrams":  # of contents that are gone, some stay until the index is written anew
            a = a.join(b.select("content_hash").distinct(), "content_hash", "left_semi")
        assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect())), name
    assert {r.dst for r in over("a").edges().filter("src = 'web/z.ts'").collect()} == {"web/dir/index.ts"}
    for query in ("changed_2", "words of step"):
        found = [[(r.id, round(r.score, 9)) for r in over(s).search(query, 5).collect()] for s in "ab"]
        assert found[0] == found[1] and found[0]
    assert over("a").grep("changed_1").count() == 0 and over("a").grep("changed_2").count() == 1
    monkeypatch.setattr(store, "GENERATIONS", 4)
    (root / "app/last.py").write_text("x = 'the last file, with words enough to be kept as a chunk of its own'\n")
    assert over("a").index() == {"status": "updated", "chunks": 1} and len(over("a").store.pointer()["generations"]) == 1
    assert len([p for p in os.listdir(tmp_path / "a") if p.startswith("g-")]) <= 5


def test_a_crash_leaves_the_index(spark, engine, monkeypatch, tmp_path):
    e, root = engine
    mine = Engine.over(spark, str(root), str(tmp_path / "ix"))
    mine.index()
    before = mine.search("login").collect()
    monkeypatch.setattr(Store, "_point", lambda self, said: 1 / 0)
    with pytest.raises(CorvaneError, match="take the place"):
        mine.store.write(whole=True, files=mine.store.read("files"))
    monkeypatch.undo()
    assert mine.search("login").collect() == before


def test_watching_a_tree(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("x")
    seen = []
    w = watch.TreeWatcher(spark, str(root), lambda: seen.append(1) or 1 / 0, str(tmp_path / "state"))
    w.look()
    w.look()
    assert not seen
    (root / "b.py").write_text("x")
    w.look()
    (root / "c.pyc").write_text("ignored")
    os.remove(root / "a.py")
    w.look()
    assert not seen and w.changes == 2
    w.look()
    w.look()
    assert seen == [1] and not w.pending
    w.start("100 milliseconds")
    assert w.query.isActive
    w.stop()


def test_errors():
    for code in CODES:
        x = CorvaneError(code, "a < b", path="x")
        assert xml.dom.minidom.parseString(x.as_xml()) and code in x.as_text() and x.as_dict() == {"code": code, "message": "a < b", "context": {"path": "x"}}
        assert CorvaneError(code, "m", "do this").as_text().endswith("do this")
    with pytest.raises(ValueError):
        CorvaneError("NO_SUCH", "x")


def events(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = [("a.py", "modified", False, t(0)), ("b.py", "created", False, t(1)), ("c", "created", True, t(2)), (".git/x", "modified", False, t(2)), ("../out", "modified", False, t(2)), ("a.py", "deleted", False, t(10)), (None, "x", False, t(30)), ("z.py", "moved", False, t(60))]
    return spark.createDataFrame(rows, watch.EVENTS)


def test_debounce(spark):
    got = watch.debounced(watch.relevant(events(spark))).orderBy("first").collect()
    assert [r.events for r in got] == [2, 1, 1] and all((r.settled - r.last).total_seconds() == 2 for r in got)


def test_streams(spark, tmp_path):
    events(spark).coalesce(1).write.json(str(tmp_path / "in"))
    q = watch.write_debounced(watch.events_of(spark, str(tmp_path / "in")), "bursts", str(tmp_path / "cp"))
    q.awaitTermination(60)
    # the last burst waits for the watermark to pass it
    assert sorted(r.events for r in spark.table("bursts").collect()) == [1, 2]
    seen = []
    w = watch.Watcher("r", watch.events_of(spark, str(tmp_path / "in")), lambda: seen.append(1) or 1 / 0, str(tmp_path / "cp2")).start()
    w.query.awaitTermination(60)
    assert seen == [1] and w.query.exception() is None and not w.is_running
    w.stop()
