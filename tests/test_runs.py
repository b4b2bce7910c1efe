import dataclasses
import json
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark import cli
from loomspark.operators import chunking
from loomspark.plans import jobs, pipeline
from loomspark.plans.providers import Cache, Call, StubProvider, ask
from loomspark.sinks import card, exports, runs
from loomspark.sources import files, pages, settings
from loomspark.sources.pages import text_of
from loomspark.streaming import ingest

TEXT = " ".join(f"The river number {k} carries cold water past town {k * 7}." for k in range(60))


@pytest.fixture
def chunks(spark):
    return chunking.chunk_text(spark.createDataFrame([("doc", TEXT)], "source string, text string"), "source", target_chars=400)


def rows_of(df):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.drop("metadata").collect())


def test_run_is_the_same_for_any_partitioning(spark, chunks, tmp_path):
    config = pipeline.Config("a guide to rivers", target_examples=8, seeds_per_chunk=2, seeds_from_description=4, min_hallucination_overlap=0.0, min_judge_score=6, evol_factor=0.5, generate_dpo_pairs=True, dpo_target_pairs=5)
    a = pipeline.run(spark, config, chunks, StubProvider(), run_dir=str(tmp_path / "run"))
    b = pipeline.run(spark, config, chunks.repartition(5), StubProvider())
    assert rows_of(a.examples) == rows_of(b.examples) and rows_of(a.pairs) == rows_of(b.pairs)
    stats = a.stats.first()
    assert stats["kept"] == 8 == a.examples.count() and stats["dpo_pairs"] == a.pairs.count()
    assert all(r["chosen_score"] > r["rejected_score"] for r in a.pairs.collect())

    class Broken:
        def generate(self, prompt, **_):
            raise AssertionError("a finished run asks nothing again")

    c = pipeline.run(spark, config, chunks, Broken(), run_dir=str(tmp_path / "run"))
    assert rows_of(c.examples) == rows_of(a.examples)
    manifest = runs.write(a, config, settings.Settings(provider="stub"), tmp_path / "out", formats="jsonl,openai,flat", stem="s", tool_calling=True)
    assert manifest["train_size"] == 7 and manifest["eval_size"] == 1 and manifest["tool_calling_count"] == 0
    assert len(json.load(open(manifest["files"]["flat_json"]))) == 7
    assert (tmp_path / "out/README.md").read_text().startswith("---\nlanguage:\n- en\n") and (tmp_path / "out/s.manifest.json").exists()


def test_copies_are_asked_once_and_only_a_wave_is_gated(spark, tmp_path, monkeypatch):
    class Noting(StubProvider):
        def generate(self, prompt, **k):
            (tmp_path / "asked" / uuid.uuid4().hex).write_text(prompt)
            return StubProvider.generate(self, prompt, **k)

    (tmp_path / "asked").mkdir()
    sizes, diversity = [], pipeline.dedup.diversity
    monkeypatch.setattr(pipeline.dedup, "diversity", lambda items, *a, **k: sizes.append(items.count()) or diversity(items, *a, **k))
    docs = spark.createDataFrame([(str(k), TEXT if k < 3 else TEXT.replace("river", f"road {k}")) for k in range(6)] * 2, "source string, text string")
    chunks = chunking.chunk_text(docs, "source", target_chars=400)
    config = pipeline.Config("a guide", target_examples=3, seeds_per_chunk=2, seeds_from_description=0, min_hallucination_overlap=0.0, min_judge_score=6, wave=8)
    out = pipeline.run(spark, config, chunks, Noting(), run_dir=str(tmp_path / "run"))
    asked = [p.read_text() for p in (tmp_path / "asked").iterdir()]
    assert len(asked) == len(set(asked)) and sum("JSON array" in p for p in asked) == chunks.select("text").distinct().count()
    n = chunks.select("id").distinct().count()
    assert sizes[0] == 8 and sizes[-1] < 2 * n == out.stats.first()["generated"]
    assert "chunk_text" not in spark.read.parquet(*map(str, (tmp_path / "run").glob("*/answers"))).columns
    whole = pipeline.run(spark, dataclasses.replace(config, wave=4096), chunks, StubProvider())
    assert rows_of(out.examples) == rows_of(whole.examples) and rows_of(out.rejected) == rows_of(whole.rejected)
    assert out.stats.first() == whole.stats.first()


def test_free_form_run_without_chunks_and_overflow(spark):
    config = pipeline.Config("a guide " + TEXT[:400], target_examples=2, seeds_from_description=12, min_judge_score=4, overflow="reject", diversity_threshold=0.99)
    out = pipeline.run(spark, config, spark.createDataFrame([], files.CHUNKS), StubProvider())
    assert out.examples.count() == 2 and out.rejected.where("decision = 'overflow'").count() > 0
    assert out.examples.where(F.size("source_chunks") > 0).count() == 0


def test_dialogues(spark, chunks):
    got = pipeline.run_multiturn(spark, pipeline.MultiturnConfig("a guide", target=5, turns=5), chunks, StubProvider())
    rows = got.dialogues.collect()
    assert len(rows) == 5 and all(len(r["messages"]) == 4 and len(r["source_chunks"]) == 1 for r in rows)
    first, *others = exports.dialogues(got.dialogues, "Be kind.").first().messages
    assert first.role == "system" and len(others) == 4


def test_cache_asks_once(spark, tmp_path):
    requests = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    cache = Cache(str(tmp_path / "cache"))
    cold = Call("m", 0.0, 10)
    assert ask(requests, StubProvider(), cold, cache).where("response is not null").count() == 3
    assert ask(requests, StubProvider(), cold, cache).count() == 3
    assert (cache.hits, cache.misses, cache.stats(spark)["entries"]) == (2, 2, 2)
    ask(requests, StubProvider(), Call("m", 0.7, 10), cache).count()
    ask(requests, StubProvider(), Call("m", 0.0, 10, system="s"), cache).count()
    assert cache.stats(spark)["entries"] == 4


def test_failed_calls_leave_an_error(spark):
    class Down:
        def generate(self, prompt, **_):
            raise RuntimeError("down")

    assert ask(spark.createDataFrame([("a",)], "prompt string"), Down(), Call()).first()["error"] == "down"
    config = pipeline.Config("x")
    judged = pipeline.judge(spark.createDataFrame([("i", "o")], "instruction string, output string"), config, Down(), None).first()
    assert (judged["judge_score"], judged["judge_reason"]) == (0, "judge error: down")


def test_pages():
    page = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><p> One &amp; two<br>x</p><svg><text>no</text></svg><noscript>no</noscript><template><p>no</p></template>&copy; y</body>"
    assert text_of(page) == "One & two\nx\n© y"
    assert text_of("<p>a</p><scr") == "a" and text_of(None) is None and text_of("") == "" and text_of("<script>a</script") == ""


def test_pages_are_read_a_few_at_a_time(spark):
    html = [f"<p>{k}</p>" if k % 7 else None for k in range(1000)]
    got = list(pages._read(iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(html)], ["k", "html"])])))
    assert max(b.num_rows for b in got) <= pages.AT_ONCE < 1000
    assert [x for b in got for x in b.column(1).to_pylist()] == [str(k) if k % 7 else None for k in range(1000)]
    pages.page_text(spark.createDataFrame([(1, "<p>")], "k int, html string"), "k", "html")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_tool_calls(spark):
    rows = spark.createDataFrame([("do it", "done", '{"tool_call": {"name": "f", "arguments": {"x": 1}}}'), ("no", "none", "{}"), ("bad", "none", '{"tool_call": {"name": " ", "arguments": "{}"}}'), ("s", "ok", '{"tool_call": {"name": "g", "arguments": "{}"}}')], "instruction string, output string, m string")
    got = exports.tool_calls(rows.withColumn("metadata", F.parse_json("m")), {"name": "f"})
    found = got.collect()
    assert len(found) == 2
    m = next(r for r in found if r["messages"][1]["content"] == "do it")["messages"]
    (made,) = m[2].tool_calls
    assert m[2].content is None and made.function.arguments == '{"x":1}' and m[3].tool_call_id == made.id
    line = json.loads(exports.tool_lines(got).where("value like '%do it%'").first()["value"])
    assert "content" in line["messages"][2] and line["messages"][2]["content"] is None and [t["function"] for t in line["tools"]] == [{"name": "f"}]


def test_card():
    info = card.CardInfo("T", " d ", "Italian", "text a", {"provider": "p"}, {"train": 1500}, stats={"kept": 9}, config={"min_judge_score": 7}, tags=["Italian", "SYNTHETIC"])
    text = card.render(info)
    assert "- it\n" in text and "1K<n<10K" in text and "| kept | 9 |" in text and "| Examples wanted | ? |" in text
    assert card.tag_list(["A", "a ", ""]) == ["a", *card.OWN_TAGS]
    assert card.sources_of(["x.pdf"], [], ["u"]) == "PDF x.pdf; page u" and card.sources_of() == "the description alone"


def test_files_and_settings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Caf\xc3\xa9 one. Two \xff three.")
    assert files.text_files(spark, [str(tmp_path / "a.txt")]).first()["text"] == "Café one. Two � three."
    assert files.page_or_text("http://x/a.md?q", "text/html", "<b>") == "<b>" and files.page_or_text("http://x/a", "text/html", "<b>q</b>") == "q"
    got = files.urls(spark, ["http://x/a"], lambda u: ("text/html", "<p>hello</p>")).first()
    assert (got["source"], got["text"]) == ("http://x/a", "hello")
    with pytest.raises(ValueError):
        files.for_job(spark, {})
    assert files.for_job(spark, {"text": "Hello there."}).first()["source"] == "inline-text"
    (tmp_path / ".env").write_text("# c\nexport LOOMSPARK_PROVIDER='stub'\nLOOMSPARK_API_KEY=\n")
    s = settings.load({"LOOMSPARK_WORKSPACE": str(tmp_path / "w"), "LOOMSPARK_OPENAI_URL": "http://h/"}, tmp_path / ".env")
    assert s.provider == "stub" and s.api_key is None and s.openai_url == "http://h" and (tmp_path / "w").is_dir()
    with pytest.raises(ValueError):
        settings.load({"LOOMSPARK_PROVIDER": "x"})


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LOOMSPARK_PROVIDER", "stub")
    monkeypatch.setenv("LOOMSPARK_WORKSPACE", str(tmp_path / "w"))
    (tmp_path / "a.txt").write_text(TEXT)
    assert cli.main(["ingest", "--text", str(tmp_path / "a.txt"), "-o", str(tmp_path / "c.json"), "--target-chars", "600"], spark) == 0
    assert files.read_chunks(spark, str(tmp_path / "c.json")).count() == len(json.load(open(tmp_path / "c.json")))
    assert cli.main(["generate", "-d", "a guide", "-o", str(tmp_path / "o"), "--chunks", str(tmp_path / "c.json"), "-n", "3", "--seeds-per-chunk", "1", "--min-hallucination-overlap", "0", "--min-judge-score", "4"], spark) == 0
    assert cli.main(["multiturn", "-d", "a guide", "-o", str(tmp_path / "m"), "-n", "2"], spark) == 0
    assert cli.main(["version"]) == 0 and cli.VERSION in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["ingest", "-o", "x"], spark)


def test_jobs(spark, tmp_path):
    service = jobs.Service(spark, settings.Settings(provider="stub", workspace=tmp_path))
    job = service.submit("generate_from_text", {"text": TEXT, "description": "a guide", "target_examples": 2, "min_judge_score": 4})["job_id"]
    done = service.wait(job, 300)
    assert done["status"] == "succeeded", done
    assert service.list(5, "succeeded")[0]["id"] == job and service.store.table(spark).count() == 1
    with pytest.raises(ValueError):
        service.submit("generate_from_text", {"description": "x"})
    with pytest.raises(ValueError):
        service.submit("generate_from_text", {"text": "x", "description": "x", "concurrency": 99})
    assert not service.cancel(job)["cancelled"] and service.health()["status"] == "ok"


def test_stream_adds_each_chunk_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string")
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):  # the same document arrives twice
        docs.write.mode("append").parquet(source)
        ingest.append_new(ingest.chunk_stream(ingest.document_stream(spark, source)), table, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(table).count() == chunking.chunk_text(docs, "doc_id").count()
