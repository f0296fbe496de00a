import base64

import numpy as np
import pytest

from lodestone.operators import dense
from lodestone.sources import files

ROW = "name string, content_base64 string, path string"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("in box")
    (at / "deep").mkdir()
    (at / "a.TXT").write_bytes("grün\x00".encode())
    (at / "deep" / "b.md").write_bytes(b"# T\n\xe9")
    (at / "c.fb2").write_bytes(b"<FictionBook><body><section><p>hello</p></section></body></FictionBook>")
    (at / "d.docx").write_bytes(b"no zip")
    (at / "e.exe").write_bytes(b"x")
    (at / "none").write_bytes(b"x")
    return at


def test_files_are_read_by_their_extension(spark, root):
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_any(spark, str(root)).collect()}
    assert set(got) == {"a.TXT", "b.md", "c.fb2", "d.docx", "e.exe", "none"}
    assert (got["a.TXT"].text, got["b.md"].text) == ("grün", "# T\né") and "hello" in got["c.fb2"].text
    assert "BadZipFile" in got["d.docx"].error and got["d.docx"].text is None
    assert "'exe'" in got["e.exe"].error and "no parser" in got["none"].error
    assert all(got[n].error is None for n in ("a.TXT", "b.md", "c.fb2"))


@pytest.mark.parametrize(("path", "want"), [("a", "a"), ("./a//b/../c", "a/c"), ("a/../../b", None), ("..", None), ("/etc/x", None), ("C:\\x", None), ("a\\..\\..\\b", None), ("a/..", None), ("", None), (None, None), ("...", "...")])
def test_paths_stay_inside(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(files.inside("p")).first()[0] == want


def test_what_is_handed_in_is_content_or_a_file_of_the_folder(spark, root):
    b64 = base64.b64encode("höhe".encode()).decode()
    rows = [("x.txt", b64, None), (None, None, "deep/b.md"), ("n.md", "", "./deep/../a.TXT"), ("both", b64, "a.TXT"), ("neither", None, ""), ("out", None, "../secret"), ("gone", None, "nope.txt"), ("bad", "***", None), ("t.exe", b64, None)]
    got = {r.path: r for r in files.received(spark.createDataFrame(rows, ROW), str(root)).collect()}
    assert (got["x.txt"].text, got["b.md"].text, got["n.md"].text) == ("höhe", "# T\né", "grün")
    said = {n: got[n].error for n in ("both", "neither", "out", "gone", "bad", "t.exe")}
    assert said["both"] == said["neither"] == "give either content or a path" and said["out"] == "the path must stay within its folder"
    assert said["gone"] == "there is no file nope.txt" and said["bad"] == "the content is not Base64" and "no parser" in said["t.exe"]
    assert len(got) == len(rows) and files.received(spark.createDataFrame([], ROW), str(root)).count() == 0


@pytest.mark.parametrize("diversity", [0.0, 0.3, 0.5, 0.9])
def test_diverse_hits_are_the_greedy_choice(spark, diversity):
    draw = np.random.default_rng(4)
    x, q = draw.normal(size=(40, 5)), draw.normal(size=(3, 5))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, embedding array<double>")
    got = {}
    for r in dense.diverse(corpus, queries, 6, diversity, pool=25).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    for i in range(3):
        score = u @ v[i]
        pool, chosen = sorted(np.argsort(-score)[:25].tolist(), key=lambda j: -score[j]), []
        while len(chosen) < 6:
            worth = {j: (1 - diversity) * score[j] - diversity * max((u[j] @ u[c] for c in chosen), default=0.0) for j in pool if j not in chosen}
            chosen.append(max(worth, key=lambda j: (worth[j], -pool.index(j))))
        assert got[i] == chosen


HEAD = "<FictionBook><description><title-info><author><first-name>A</first-name></author><book-title>T &amp; U</book-title></title-info></description>"


@pytest.mark.parametrize(
    ("body", "text", "heads"),
    [
        ("<body><section><title><p>One</p></title><p>Text & more.</p></section></body></FictionBook>", "One\n\nText & more.", [(0, 1, "One")]),
        ("<body><section><title><p>One</title><p>Text.<section><title><p>Two</p></title><p>End", "One\n\nText.\n\nTwo\n\nEnd", [(0, 1, "One"), (12, 2, "Two")]),
        ("<body><section></b><title><p>One</p></title></i><p>a <emphasis>b</p><p>c</p></section></body>", "One\n\na b\n\nc", [(0, 1, "One")]),
        ("<body><section><title><p>One</p></title><p>x &nbsp; y &bogus; z</p><empty-line/></section></body>", "One\n\nx y &bogus; z", [(0, 1, "One")]),
    ],
)
def test_broken_books_keep_their_headings(body, text, heads):
    got = files.parse_fb2((HEAD + body).encode())
    if body.startswith("<body><section><title><p>One</title>"):
        assert "Text." in got["text"] and [h["text"] for h in got["headings"]][:1] == ["One"] and got["text"].endswith("End")
    else:
        assert (got["text"], [(h["pos"], h["level"], h["text"]) for h in got["headings"]]) == (text, heads)
    assert got["error"] and (got["title"], got["author"]) == ("T & U", "A")


def test_whole_books_charsets_and_other_files():
    whole = (HEAD + "<body><p>x</p></body></FictionBook>").encode()
    assert files.parse_fb2(whole)["error"] is None and files.parse_fb2(whole)["text"] == "x"
    other = ('<?xml version="1.0" encoding="windows-1251"?>' + HEAD + "<body><p>Глава</body>").encode("windows-1251")
    assert files.parse_fb2(other)["text"] == "Глава"
    assert files.parse_fb2(b'<?xml version="1.0" encoding="none-such"?><FictionBook><body><p>x</body>')["text"] == "x"
    for odd in (b"not xml", b"", b"<a><b>", b"\xff\xfe"):
        got = files.parse_fb2(odd)
        assert got["headings"] == [] and got["error"]
