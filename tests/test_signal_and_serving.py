import io
import os
import pathlib
import random
import shutil
import statistics
import subprocess
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmerge.operators import audit, serving, signal, structural
from quillmerge.sources import wav
from quillmerge.sources.files import app_contacts
from quillmerge.sources.store import Store


def sine(rate, seconds, gain=1.0, freq=997):
    return gain * np.sin(2 * np.pi * freq * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize(("rate", "tolerance"), [(48000, 0.1), (44100, 0.1), (16000, 0.2)])
def test_loudness_of_a_full_scale_sine(rate, tolerance):
    assert abs(signal.loudness(sine(rate, 3), rate)[0] + 3.01) < tolerance


def test_loudness_is_gated_and_abstains():
    tone = sine(16000, 2)
    with_silence = np.concatenate([tone, np.zeros(48000)])
    assert abs(signal.loudness(tone, 16000)[0] - signal.loudness(with_silence, 16000)[0]) < 0.5
    assert signal.loudness(sine(16000, 0.2), 16000) == (None, None)
    assert signal.loudness(np.zeros(16000), 16000) == (None, None)


def test_levels(spark):
    rows = [(1, (0.5 * sine(1000, 2, freq=100)).tolist()), (2, [0.0] * 100), (3, np.clip(4 * sine(1000, 1, freq=10), -1, 1).tolist())]
    got = {r.k: r for r in signal.with_levels(spark.createDataFrame(rows, "k int, s array<double>"), "s").collect()}
    assert abs(got[1].rms_dbfs + 9.03) < 0.1 and abs(got[1].crest_db - 3.01) < 0.5
    assert got[2].peak_dbfs == -120 and got[3].clipping_pct > 20 and got[3].peak_dbfs == 0


def test_signal_to_noise(spark):
    r = np.random.default_rng(7)
    noise = 0.01 * r.normal(size=8000)
    bursts = noise + np.where(np.arange(8000) // 1000 % 2, sine(1000, 8, 0.5, 100), 0)
    df = spark.createDataFrame([(1, bursts.tolist()), (2, sine(1000, 8, freq=100).tolist())], "k int, s array<double>")
    got = {x.k: x for x in signal.frame_stats(df, "k", "s", 50).collect()}
    assert got[1].estimated_snr_db > 15 and abs(got[1].speech_ratio_pct - 50) < 12
    assert got[2].estimated_snr_db is None and got[2].snr_note.startswith("frames differ by 0.0 dB") and got[1].snr_note is None


def test_quality_never_blames_the_unknown(spark):
    null = F.lit(None).cast("double")
    row = spark.range(1).select(signal.quality(null, null, null, null, null, null, null).alias("q"), signal.quality(F.lit(5.0), F.lit(2.0), F.lit(-50.0), F.lit(0.5), F.lit(8000), F.lit(90.0), F.lit(0.1)).alias("w")).first()
    assert (row.q.score, row.q.label) == (100, "excellent") and (row.w.score, row.w.label) == (0, "poor")


def test_tags(spark):
    rows = [("AUTOMATION-HEAVY ", "0.5", None), ("chef", None, "unknown_category"), ("", None, "unknown_category"), ("data, web-dev", "1", "unknown_category"), ("data", "1.2", "bad_confidence"), ("data", "x", "bad_confidence"), ("data", "", None)]
    df = spark.createDataFrame(rows, "c string, x string, error string")
    for r in df.select(serving.checked_tag(F.col("c"), F.col("x")).alias("t"), "error").collect():
        assert r.t.error == r.error
    tagged = spark.createDataFrame([("a", 1, "data"), ("a", 2, "web-dev"), ("b", 1, "data")], "k string, ts int, category string")
    assert {(r.k, r.category) for r in serving.upserted(tagged, "k", "ts").collect()} == {("a", "web-dev"), ("b", "data")}


def test_stub_tags(spark):
    rows = [("p", "React"), ("p", "JavaScript"), ("q", "Pandas"), ("q", "React"), ("r", "Cobol")]
    got = {r.root: (r.category, r.confidence) for r in serving.stub_tags(spark.createDataFrame(rows, "root string, skill string")).collect()}
    assert got == {"p": ("web-dev", 0.95), "q": ("generalist", 0.45), "r": ("generalist", 0.4)}


def test_model_replies(spark):
    rows = [('```json\n{"category": "Data ", "confidence": 0.5}\n```', "data", 0.5), ('{"category": "data", "confidence": 7}', "data", None), ("no", None, None)]
    for r in spark.createDataFrame(rows, "t string, c string, x double").select(serving.parsed_reply(F.col("t")).alias("p"), "c", "x").collect():
        assert (r.p.category, r.p.confidence) == (r.c, r.x)


def test_incoming_columns(spark):
    df = spark.createDataFrame([("Asha", " ", "9000000001", "x"), ("", "", "", ""), ("name", "E-mail", "Mobile", "Extra"), ("", "", "", "note")], "`Name` string, `E-mail` string, `Mobile` string, `Extra` string")
    got = [(r.in_name, r.in_email, r.in_phone, r.skip_reason) for r in serving.mapped_columns(df).collect()]
    assert got == [("Asha", "", "9000000001", None), ("", "", "", "blank_row"), ("name", "E-mail", "Mobile", "repeated_header"), ("", "", "", "no_identity")]


def test_rotation(spark):
    clean = ["asha@x.test", "Asha Rao", "15k/month", "Pune", "Active", "n8n, Python"]
    rows = [(clean,), (clean[5:] + clean[:5],), (["a", "b", "c", "d", "e", "f"],)]
    got = structural.with_rotation(spark.createDataFrame(rows, "v array<string>"), "v").collect()
    assert [r.shift for r in got] == [0, 1, 0] and got[1].repaired == clean and (got[1].score_before, got[1].score_after) == (0.0, 6.0)


def test_row_outcomes(spark):
    rows = [([" ", ""], "blank_row"), (["A ", "b"], "repeated_header"), (["x"], "column_count_mismatch"), (["x", "y"], "ok")]
    for r in spark.createDataFrame(rows, "v array<string>, want string").select(structural.row_outcome(F.col("v"), ["a", "B"]).alias("got"), "want").collect():
        assert r.got == r.want


def test_queries_import_without_the_optional_folder(tmp_path):
    """A copy without the two folders and the pipeline still lists its queries."""
    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "quillmerge", tmp_path / "quillmerge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert {'golden_people', 'dup_check'} <= set(q) and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def plain_biquad(x, b, a):
    y, z1, z2 = [], 0.0, 0.0
    for v in x:
        out = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * out + z2, b[2] * v - a[2] * out
        y.append(out)
    return np.array(y)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_block_filter_is_the_recursion(n):
    x = np.random.default_rng(n).normal(size=(3, n))
    for b, a in signal.weighting(48000):
        got = signal.biquad(x, b, a)
        assert got.shape == x.shape
        for row, want in zip(got, x, strict=True):
            assert np.allclose(row, plain_biquad(want, b, a), atol=1e-9)


def test_weighting_gives_the_published_coefficients():
    """ITU-R BS.1770 states both stages at 48 kHz."""
    shelf, low = signal.weighting(48000)
    assert np.allclose(shelf[0], [1.53512485958697, -2.69169618940638, 1.19839281085285], atol=1e-6)
    assert np.allclose(shelf[1], [1, -1.69065929318241, 0.73248077421585], atol=1e-6)
    assert np.allclose(low[0], [1, -2, 1]) and np.allclose(low[1], [1, -1.99004745483398, 0.99007225036621], atol=1e-6)


def test_loudness_of_a_table_is_that_of_each_clip(spark):
    rows = [(k, (0.1 * k * sine(16000, 0.5 + 0.1 * (k % 3))).tolist(), 16000.0 if k % 2 else 8000.0) for k in range(1, 7)] + [(9, None, 16000.0), (10, [], 16000.0), (11, [0.5] * 9000, None)]
    got = {r.k: r.integrated_lufs for r in signal.with_loudness(spark.createDataFrame(rows, "k int, s array<double>, rate double"), "s", "rate").collect()}
    for k, s, rate in rows[:6]:
        want = signal.loudness(np.array(s), rate)[0]
        assert got[k] == want or abs(got[k] - want) < 1e-9
    assert got[9] is None and got[10] is None and got[11] is None


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_files_of_all_widths(width):
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.75])
    whole = np.round(x * 2 ** (8 * width - 1)).astype(np.int64) + (128 if width == 1 else 0)
    raw = whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    body = io.BytesIO()
    with wave.open(body, "wb") as file:
        file.setnchannels(2)
        file.setsampwidth(width)
        file.setframerate(8000)
        file.writeframes(raw)
    samples, rate, channels, bits, backend, error = wav.decode(body.getvalue())
    assert np.allclose(samples, x.reshape(-1, 2).mean(axis=1)) and (rate, channels, bits, backend, error) == (8000, 2, 8 * width, "wave", None)


def test_clips_that_cannot_be_read_keep_their_row(spark):
    good = spark.createDataFrame([(1, sine(16000, 1, 0.5).tolist())], "k int, s array<double>").select("k", wav.encoded(F.col("s"), 16000).alias("content")).first().content
    rows = [(1, good), (2, good[:30]), (3, b"RIFFxxxxWAVEjunk"), (4, b""), (5, None), (6, b"OggS")]
    got = {r.k: r for r in signal.analysed(wav.decoded(spark.createDataFrame(rows, "k int, content binary")), "k").collect()}
    assert len(got) == 6 and got[1].error is None and abs(got[1].rms_dbfs + 9.03) < 0.1 and got[1].seconds == 1.0 and got[1].label
    assert all(got[k].error and got[k].score is None for k in (2, 3, 4, 5, 6)) and got[6].error == "not_wav"


def test_quality_tells_what_it_left_out_and_that_all_is_well(spark):
    q = lambda snr, note: signal.quality(snr, F.lit(0.0), F.lit(-10.0), F.lit(5.0), F.lit(16000), F.lit(0.0), F.lit(0.0), note)
    none = F.lit(None).cast("double")
    row = spark.range(1).select(q(none, F.lit("flat")).alias("a"), q(F.lit(30.0), F.lit(None).cast("string")).alias("b"), q(F.lit(5.0), F.lit("flat")).alias("c")).first()
    assert row.a.reasons == ["no signal-to-noise figure: flat"] and row.a.score == 100
    assert row.b.reasons == [signal.NO_DEFECT] and row.b.score == 100
    assert row.c.reasons == ["estimated SNR below 10 dB"] and row.c.score == 70


def test_empty_clips_keep_their_row(spark):
    clips = spark.createDataFrame([(1, [], 16000, None), (2, None, None, "not_wav"), (3, [0.5] * 16000, 16000, None)], "k int, samples array<float>, rate int, error string")
    got = {r.k: r for r in signal.analysed(clips, "k").collect()}
    assert [got[k].analysis_note for k in (1, 2, 3)] == ["no samples", "not_wav", None] and [got[k].analysis_ok for k in (1, 2, 3)] == [False, False, True]
    assert got[1].score is None and got[3].reasons[0].startswith("no signal-to-noise figure")


def test_batch_totals(spark):
    verdicts = spark.createDataFrame([(1, "duplicate"), (2, "new"), (3, "new")], "row_id int, verdict string")
    rows = spark.createDataFrame([("A@Example.com",), ("b@mail.example.com",), ("c at example.com",), (None,)], "in_email string")
    (told,) = serving.batch_totals(verdicts, rows).collect()
    assert told.undeliverable == 1 and told.has_duplicates and told.summary == "3 row(s): 1 duplicate, 2 new, 0 need review"
    (none,) = serving.batch_totals(verdicts.limit(0), rows.limit(0)).collect()
    assert none.undeliverable == 0 and not none.has_duplicates and none.summary.startswith("0 row(s)")


def test_quality_gives_reasons(spark):
    q = signal.quality(F.lit(15.0), F.lit(0.5), F.lit(-10.0), F.lit(5.0), F.lit(16000), F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(q.alias("q")).first().q.reasons == ["estimated SNR below 20 dB", "some samples clipped"]


def test_exact_medians(spark):
    r = random.Random(4)
    rows = [(g, r.choice([None, r.randint(0, 5) * 1.5, r.random()])) for g in ("a", "b", None) for _ in range(101)] + [("c", 2.0), ("d", None), ("e", 1.0), ("e", 4.0)]
    got = {x.g: (x.median, x.n) for x in audit.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got == {g: (statistics.median(vs), len(vs)) for g, vs in want.items()}
    assert audit.medians(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_requests(spark):
    rows = [('[{"a": "1"}, 7, null]', [{"a": "1"}, {}, {}], None), ('{"a": 1}', None, "not_a_list"), ("", None, "not_a_list"), (None, None, "not_a_list"), ("[]", [], None), ("[" + ",".join(["{}"] * 1001) + "]", None, "too_many_rows")]
    for r in spark.createDataFrame(rows, "b string, rows array<map<string, string>>, error string").select(serving.request_rows(F.col("b")).alias("r"), "rows", "error").collect():
        assert (r.r.rows, r.r.error) == (r.rows, r.error)


def test_digest_names_the_first_few(spark):
    rows = [(k, "duplicate") for k in range(20, 0, -1)] + [(k, "new") for k in range(30, 40)] + [(41, "needs_review")]
    got = {r.verdict: r.line for r in serving.digest(spark.createDataFrame(rows, "row_id int, verdict string")).collect()}
    assert got == {"duplicate": "1, 2, 3, 4, 5, +15 more", "needs_review": "41"}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from quillmerge.streaming.incoming import start_checks

    rows = spark.createDataFrame([(1, "Asha Rao", "", "9000000001", "Pune"), (2, "New One", "n@x.org", "", "")], "row_id int, in_name string, in_email string, in_phone string, in_city string")
    rows.write.parquet(str(tmp_path / "in"))
    people = spark.createDataFrame([("r1", "Asha Rao", None, "9000000001", "Pune")], "root string, full_name string, email string, phone string, city string")
    for mark in ("one", "two"):  # the second run has lost its checkpoint and takes the batch again
        start_checks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), people, str(tmp_path / "out"), str(tmp_path / mark)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.row_id, r.verdict) for r in got.collect()} == {(1, "duplicate"), (2, "new")} and got.count() == 2


def test_tables_are_swapped_together_and_durable_ones_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.read("people")
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    two = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert store.durable("log", one.schema).count() == 0
    store.rebuild({"people": one})
    before = store.read("people")
    store.append_new("log", two, "k")
    assert store.rebuild({"people": two}) == 2
    store.append_new("log", one, "k")
    assert store.read("people").count() == 3 and before.count() == 1
    assert {(r.k, r.v) for r in store.durable("log", one.schema).collect()} == {(1, "b"), (2, "c")}
    assert app_contacts(spark, str(tmp_path / "none")) is None


def test_app_contacts_need_name_and_phone(spark, tmp_path):
    rows = [(1, "Asha Rao", "9000000001", "+91 90000 00002", None), (2, "", "9000000003", "", "blr"), (3, "Bina", "9000000004", None, "blr")]
    spark.createDataFrame(rows, "contact_id long, full_name string, phone string, phone_raw string, city string").write.parquet(str(tmp_path / "c"))
    got = {r.row_number: r for r in app_contacts(spark, str(tmp_path / "c")).collect()}
    assert (got[1].phone, got[1].usable, got[1].city) == ("9000000002", True, None) and not any(p.field == "city" for p in got[1].problems)
    assert not got[2].usable and got[2].problems[-1].category == "unidentifiable_row" and got[3].city == "Bengaluru"
