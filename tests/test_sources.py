import json

from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.sources import readers as RD
from lorekeep.sources import writers as WR

FILE = "path string, text string"


def test_read_notes_defaults_and_unknown_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"note_id": "a", "title": "A", "body_sections": {"z": "1", "b": "2"}, "extra": 1, "created_at": "", "updated_at": "2026-01-01T00:00:00+00:00"}, indent=2))
    n = RD.read_notes(spark, str(tmp_path)).first()
    assert (n.aliases, n.summary, n.confidence, n.created_at) == ([], "", 0.8, None)
    assert [s.key for s in n.body_sections] == ["z", "b"] and str(n.updated_at) == "2026-01-01 00:00:00"


def test_history_and_claim_log(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.jsonl").write_text('{"note_id": "a", "title": "A1"}\n\n{"note_id": "a", "title": "A2"}\n')
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text('{"note_id": "a", "title": "A3"}')
    got = RD.read_history(spark, str(tmp_path / "h"), RD.read_notes(spark, str(tmp_path / "n"))).collect()
    assert sorted(r.title for r in got) == ["A1", "A2", "A3"] and [r.title for r in sorted(got, key=lambda r: r.seq)] == ["A1", "A2", "A3"]
    (tmp_path / "c.jsonl").write_text('{"claim_id": "c", "note_id": "a", "text": "x", "valid_to": "", "detail": {"k": "v"}, "zzz": 1}\n\n{"claim_id": "c", "note_id": "a", "text": "y", "valid_to": "2026-01-02"}\n')
    log = RD.read_claim_log(spark, str(tmp_path / "c.jsonl")).orderBy("seq").collect()
    assert [r.text for r in log] == ["x", "y"] and log[0].valid_to is None and log[1].valid_to is not None


def test_text_files_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.MD").write_bytes(b"ok \xff")
    (tmp_path / "b.html").write_text("<p>x</p><script>y</script>")
    (tmp_path / "c.bin").write_text("no")
    got, failed = RD.read_text_files(spark, str(tmp_path))
    assert {r.name: r.text for r in got.collect()} == {"a.MD": "ok �", "b.html": "x"} and failed.count() == 0


def test_import_vault(rows):
    files = rows([
        ("One.md", "---\ntitle: First\ntags: [#a, 'b']\naliases:\n  - uno\n---\n# H\n\nSome  text [[Two#x|y]] [[First]] [[Two]]."),
        ("sub/first.md", "---\ntitle: first\n---\nclash"), (".obsidian/x.md", "hidden"), ("empty.md", " \n"), ("bad.md", "---\ntitle: [x\n---\nbody"),
        ("same.md", "seen"),
    ], FILE)
    seen = files.where("path = 'same.md'").select("path", F.sha2("text", 256).alias("hash"))
    out = RD.import_vault(files, seen)
    got = {r.note_id: r for r in out["notes"].collect()}
    assert set(got) == {"first", "bad"}
    n = got["first"]
    assert (n.title, n.tags, n.aliases, n.summary) == ("First", ["a", "b"], ["uno"], "Some text [[Two#x|y]] [[First]] [[Two]].")
    assert [r.target for r in n.relations] == ["Two"] and n.confidence == 1.0
    assert [r.path for r in out["duplicates"].collect()] == ["sub/first.md"]
    assert {r.path for r in out["skipped"].collect()} == {"empty.md", "same.md"}


def test_sections_h1(rows):
    got = RD.split_sections_h1(rows([("a/x.md", "drop\n# One \nbody\n#Two\n# Three\n"), ("y.txt", " plain ")], FILE)).orderBy("path", "section_id").collect()
    assert [(r.section_id, r.title, r.text) for r in got] == [("001", "One", "body\n#Two"), ("002", "Three", ""), ("001", "y.txt", "plain")]


def test_sections_h2_titles_are_unique(rows):
    long = "x" * 130
    a = f"# Doc\n{long}\n## Setup\n{long}\n```\n## not a heading\n```\n## Tiny\nshort\n"
    b = f"# Doc\n## Setup\n{long}\n## **New** ✅\n{long}\n"
    got = RD.split_sections_h2(rows([("a.md", a), ("b.md", b)], FILE)).orderBy("path", "pos").collect()
    assert [(r.path, r.title, r.part_of) for r in got] == [
        ("a.md", "Doc", None), ("a.md", "Setup", "Doc"), ("b.md", "Setup — Doc (b)", "Doc (b)"), ("b.md", "New", "Doc (b)"),
    ]
    notes = RD.section_notes(RD.split_sections_h2(rows([("a.md", a)], FILE))).collect()
    assert {n.note_id for n in notes} == {"doc", "setup"}


def test_eval_cases(spark, tmp_path):
    cases = [{"id": "a-1", "question": "q", "relevant": ["T"], "category": "direct"}, {"question": " ", "relevant": ["T"]}, {"question": "n", "relevant": [], "category": "negative"}, {"question": "m", "relevant": []}]
    (tmp_path / "l.json").write_text(json.dumps(cases))
    (tmp_path / "w.json").write_text(json.dumps({"cases": cases}))
    for name in ("l.json", "w.json"):
        assert sorted(r.question for r in RD.read_eval_cases(spark, str(tmp_path / name)).collect()) == ["n", "q"]
    assert RD.read_eval_cases(spark, str(tmp_path / "l.json"), "negative").first().question == "n"


def test_judged_corpus(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n{"_id": "d2", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2", "text": "b"}\n')
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq2\td2\t0\n")
    got = RD.read_judged_corpus(spark, str(tmp_path))
    assert got["docs"].count() == 2 and [r.query_id for r in got["queries"].collect()] == ["q1"] and got["qrels"].first().grade == 2


def test_longmem_rules(spark, tmp_path):
    good = {"question_id": "a", "question_type": "t", "question": "q", "answer": 3, "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": True}]], "haystack_dates": ["d"], "question_date": "d", "answer_session_ids": ["s"]}
    bad = [{**good, "answer": []}, {**good, "haystack_dates": []}, {**good, "haystack_sessions": [[{"role": "user"}]]}, {k: v for k, v in good.items() if k != "question"}]
    (tmp_path / "l.json").write_text(json.dumps([good, *bad]))
    items, turns, violations = RD.read_longmem(spark, str(tmp_path / "l.json"))
    assert [(r.question_id, r.answer) for r in items.collect()] == [("a", "3")]
    assert [(r.session, r.turn, r.role, r.content, r.date) for r in turns.collect()] == [(0, 0, "user", "hi", "d")]
    assert sorted(r["index"] for r in violations.collect()) == [1, 2, 3, 4]


def test_scan_reasons_in_order(rows):
    data = [("readme.md", 10, b"x"), ("src/a.py", 10, b"x"), ("src/.env", 3, b"x"), ("yarn.lock", 3, b"x"), ("a.bin", 3, b"x"), ("big.md", 2_000_000, b"x"), ("nul.md", 3, b"a\x00"), ("hex.md", 3, b"\x10\x01"),
            ("logs/x.md", 3, b"x"), ("a.tmp.md", 3, b"x"), ("node_modules/i.js", 3, b"x"), ("skip.md", 3, b"x"), ("z.md", 3, b"x")]
    files = rows([(p, n, bytearray(h)) for p, n, h in data], "path string, bytes long, head binary")
    plan = RD.scan_tree(files, ["# c", "logs/", "*.tmp.md", "!z.md"], exclude=["skip*"], max_files=3)
    got = {r.path: r.reason for r in plan.collect()}
    assert got == {
        "readme.md": "", "hex.md": "", "src/a.py": "", "z.md": "--max-files", "src/.env": "secret-like file", "yarn.lock": "lockfile",
        "a.bin": "unsupported type", "big.md": "over size threshold", "nul.md": "binary", "logs/": ".gitignore", "a.tmp.md": ".gitignore", "skip.md": "--exclude",
    }
    totals = {r.category: r.files for r in RD.scan_totals(plan).collect()}
    assert totals[None] == 3


def test_glob_regex():
    import re

    for pattern, text, want in (("*.py", "a/b.py", True), ("[!a]?.md", "bc.md", True), ("[!a]?.md", "ac.md", False), ("a+b", "a+b", True), ("x*", "ax", False)):
        assert bool(re.match(RD.glob_regex(pattern).replace(r"\z", r"\Z"), text)) is want


def test_markdown_round_trip(rows):
    from lorekeep import schema as SC
    from tests.test_temporal import note

    notes = rows([note("a", "Alpha", aliases=["al"], tags=["t"], summary="Sum.", body_sections=[("how_to", "Use Beta now. Beta again."), ("notes", "big Beta Max")])], SC.NOTES)
    links = rows([("a", "Beta", "[[Beta|Beta]]"), ("a", "Beta Max", "[[BM|Beta Max]]")], "note_id string, anchor string, link string")
    page = WR.render_markdown(notes, links).first().markdown
    assert "## How To\n\nUse [[Beta|Beta]] now. Beta again." in page and "big [[BM|Beta Max]]" in page
    assert page.endswith("## Related\n\n- [[BM|Beta Max]]\n- [[Beta|Beta]]\n")
    back = M.parse_note_markdown(rows([("p", page)], FILE)).first()
    assert (back.id, back.title, back.aliases, back.tags, back.summary) == ("a", "Alpha", ["al"], ["t"], "Sum.")
    assert [s.key for s in back.body_sections] == ["how_to", "notes"]


def test_graph_rejects_incomplete_rows(rows, tmp_path, spark):
    nodes = rows([("n", "note", "N"), ("", "note", "x"), ("m", "note", None)], "id string, kind string, label string")
    edges = rows([("n", "m", "uses"), ("n", "", "uses")], "source string, target string, type string")
    parts = WR.check_graph(nodes, edges)
    assert (parts["nodes"].count(), parts["bad_nodes"].count(), parts["bad_edges"].count()) == (1, 2, 1)
    WR.write_graph(nodes, edges, str(tmp_path))
    assert {r.part: r.n for r in spark.read.parquet(str(tmp_path / "counts")).collect()} == {"nodes": 1, "edges": 1}


def test_session_gate(rows):
    turns = rows([(1, 0, "user", " hi "), (1, 1, "assistant", ""), (2, 0, "user", "x" * 500)], "conv_id long, turn long, role string, text string")
    diff = rows([(1, "+ line")], "conv_id long, diff string")
    sessions = RD.session_text(turns, diff)
    assert {r.conv_id for r in RD.worth_remembering(sessions).collect()} == {1, 2}
    assert {r.conv_id for r in RD.worth_remembering(RD.session_text(turns)).collect()} == {2}
    assert sessions.where("conv_id = 1").first().transcript == "user: hi"


def test_section_titles_move_no_bodies(rows):
    long = "x" * 130
    files = rows([("a.md", f"# Doc\n{long}\n## Setup\n{long}\n"), ("b.md", f"# Doc\n## Setup\n{long}\n## {'word ' * 30}\n{long}\n")], FILE)
    whole, titles = RD.split_sections_h2(files), RD.section_titles(files)
    assert titles.columns == ["path", "pos", "title", "locator", "part_of"]
    assert whole.columns == ["path", "pos", "title", "body", "locator", "part_of"] and whole.where(F.col("body").contains("x")).count() == 4
    assert sorted(map(tuple, titles.select("path", "pos", "title").collect())) == sorted(map(tuple, whole.select("path", "pos", "title").collect()))
