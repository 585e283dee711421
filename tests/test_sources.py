"""Sources: binary corpus scan, run-event envelopes and log lines read from files."""

import json

from corpuslens.sources import corpus, logs


def test_scan_corpus_layouts(spark, tmp_path):
    (tmp_path / "app" / "src").mkdir(parents=True)
    (tmp_path / "lib").mkdir()
    (tmp_path / "app" / "src" / "a.py").write_bytes(b"print('ok')\n\xff\xfe bad bytes\n")
    (tmp_path / "app" / "big.py").write_bytes(b"x" * 2000)
    (tmp_path / "lib" / "b.js").write_text("require 'x'\n")
    (tmp_path / "lib" / "notes.md").write_text("skip")
    rows = {(r.repo, r.path): r for r in corpus.scan_corpus(spark, str(tmp_path), exts=[".py", ".js"],
                                                            max_bytes=1000, repo_per_subdir=True).collect()}
    assert set(rows) == {("app", "src/a.py"), ("lib", "b.js")}
    assert rows[("app", "src/a.py")].content == "print('ok')\n bad bytes\n"
    sizes = {r.path: r.size_bytes for r in corpus.scan_corpus(spark, str(tmp_path), with_content=False).collect()}
    assert sizes["app/big.py"] == 2000 and "lib/notes.md" in sizes


def test_read_run_events_and_logs(spark, tmp_path):
    ev = tmp_path / "events.txt"
    ev.write_text("\n".join([
        "data: " + json.dumps({"state": "AUDIT", "message": "go", "data": {"run_id": "r1", "agent_messages": [
            {"sender": "Orchestrator", "recipient": "Lead Auditor", "message": "scan"}]}}),
        ": keep-alive",
        "data: " + json.dumps({"state": "TEST", "message": "t", "data": {"run_id": "r1", "result": {
            "exit_code": 1, "stdout": "", "stderr": "Traceback", "status": "COMPLETED"}}}),
    ]))
    rows = logs.read_run_events(spark, str(ev)).collect()
    assert [(r.state, r.data.run_id) for r in rows] == [("AUDIT", "r1"), ("TEST", "r1")]
    assert rows[0].data.agent_messages[0].recipient == "Lead Auditor" and rows[1].data.result.exit_code == 1
    lg = tmp_path / "log.txt"
    lg.write_text(json.dumps({"timestamp": "2024-01-01T00:00:01.500000Z", "level": "INFO", "logger": "x",
                              "message": "m", "module": "mod", "line": 7, "task_id": "t1"}) + "\nnot json\n")
    out = logs.read_logs(spark, str(lg)).collect()
    assert out[0].level == "INFO" and out[0].task_id == "t1" and out[0].agent_name is None
    assert str(out[0].ts) == "2024-01-01 00:00:01.500000" and out[1].corrupt == "not json"
