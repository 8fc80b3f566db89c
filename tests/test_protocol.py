import io

from arcwell.protocol import serve
from arcwell.store import Store


def test_requests(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    asked = ['insert data { <a> <p> "x y\\n" }', "commit", "select ?x ?v where { ?x <p> ?v }", "select count ?x where { ?x <p> ?v }", "select oops", "explain select ?x where { ?x <p> ?v }", "exit", "never"]
    out = io.StringIO()
    serve(store, io.StringIO("\n".join(asked)), out)
    lines = out.getvalue().split("\n")
    assert lines[:4] == ["ok", "\\.", "ok", "\\."]
    assert lines[4:8] == ["ok", "x v", '<a> "x\\ y\\\\n"', "\\."]
    assert lines[8:12] == ["ok", "x count", "<a> 1", "\\."]
    assert lines[12] == "error" and lines[14:16] == ["ok", "plan"] and "scan" in lines[16] and lines[-2] == "\\."
