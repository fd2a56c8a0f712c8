import hashlib
import json

import pytest

from corpusmill import cli
from corpusmill.operators import perturb, validate
from corpusmill.sources import tables


def test_commands(spark, tmp_path, capsys):
    seeds = tmp_path / "seeds.csv"
    seeds.write_text("source_id,text,target_span_start,target_span_end,target_span_text,toxicity_label,source_dataset,split\ns1,你好坏蛋,2,4,坏蛋,1,toy,train\n")
    listed = tmp_path / "list.csv"
    listed.write_text("text\nother\n")
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("validate", "--seeds", seeds, "--exclusion", listed) == 0
    assert run("validate", "--seeds", seeds) == 2
    assert run("validate", "--seeds", seeds, "--mode", "pilot") == 0
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "homo.csv").write_text("char,replacements\n坏,怀\n蛋,旦|但\n")
    assert run("generate", "--seeds", seeds, "--maps", maps, "--out", tmp_path / "v.csv", "--stats", tmp_path / "s", "--caps", "Homo=1,x") == 0
    made = tables.read_csv(spark, str(tmp_path / "v.csv"))
    assert sorted((r.attack_type, r.text) for r in made.collect()) == [("Homo", "你好怀旦"), ("Sym_Separator", "你好坏*蛋")]
    assert run("validate", "--seeds", seeds, "--variants", tmp_path / "v.csv", "--exclusion", listed) in (0, 1)
    assert run("swap", "--seeds", seeds, "--out", tmp_path / "w") == 0 and not (tmp_path / "w").exists()
    assert run("export-hashes", "--input", seeds, "--out", tmp_path / "h") == 0 and spark.read.text(str(tmp_path / "h")).count() == 2
    assert run("code-manifest", "--folder", tmp_path, "--out", tmp_path / "cm") == 0
    assert run("pilot-init", "--log", tmp_path / "log") == 0
    assert "坏*蛋" not in capsys.readouterr().err


def test_validate_faults(spark, tmp_path, capsys):
    """Files that aren't there, columns that aren't there, a safe table with a listed text, and the list's version."""
    seeds, short, listed = tmp_path / "s.csv", tmp_path / "short.csv", tmp_path / "list.csv"
    seeds.write_text("source_id,text,target_span_start,target_span_end,target_span_text,toxicity_label,source_dataset,split\ns1,abcd,1,3,bc,1,toy,train\n")
    short.write_text("source_id,text\ns1,abcd\n")
    listed.write_text("text\nother\n")
    run = lambda *a: cli.main(["validate", *map(str, a)])
    rules = lambda **k: sorted(r.rule_id for r in validate.formal_gate(**k)[1].collect())
    table = lambda path: tables.with_row(tables.read_any(spark, str(path)), "row_no")
    gone = tmp_path / "gone.csv"
    assert run("--seeds", gone, "--exclusion", listed) == 1
    assert run("--seeds", gone) == 2 and run("--exclusion", listed) == 2
    assert run("--seeds", seeds, "--exclusion", gone) == 1
    assert run("--seeds", short, "--exclusion", listed) == 1
    assert run("--seeds", seeds, "--exclusion", listed, "--safe-control", gone) == 1
    assert run("--seeds", seeds, "--exclusion", listed, "--safe-control", listed) == 1
    assert run("--seeds", seeds, "--exclusion", listed, "--expect-version", "0" * 64) == 1
    assert run("--seeds", seeds, "--exclusion", listed, "--expect-version", hashlib.sha256(listed.read_bytes()).hexdigest().upper()) == 0
    assert rules(seeds=table(short), variants=None, listed=table(listed)) == ["V01"] * 6
    assert rules(seeds=None, variants=None, listed=table(listed), absent=["seeds", "variants"]) == ["V36", "V36"]
    assert rules(seeds=table(short), variants=None, listed=None, absent=["exclusion"]) == [*["V01"] * 6, "V28"]


def test_caps():
    assert perturb.parse_caps("Homo=2, PY_Full=1,,x") == {"Homo": 2, "PY_Full": 1}
    for bad in ("Nope=1", "Homo=x"):
        with pytest.raises(ValueError):
            perturb.parse_caps(bad)


def test_builders(spark, tmp_path, capsys):
    """Seeds picked from a pool, mapping tables made for them, variants with their log, a manifest, and an entry of the pilot."""
    run = lambda *a: cli.main([str(x) for x in a])
    read = lambda name: tables.read_csv(spark, str(tmp_path / name)).collect()
    pool = tmp_path / "pool.csv"
    head = "text,toxic_entity,mech_flags,seed_normalized_hash,source_dataset,orig_file,orig_line\n"
    rows = ["你好傻狗啊,傻狗,,aaaaaaaaaa1,toy,f,1", "再说傻狗啊,傻狗,,aaaaaaaaaa2,toy,f,2", "国猪,没有|国猪,has_emoji,bbbbbbbbbb1,toy,f,3", "空,,,c1,toy,f,4", "别的,没有,,c2,toy,f,5", "一二三四五六七八,一二三四五六七,,c3,toy,f,6", *["狗狗,狗狗,,dddddddddd1,toy,f,7"] * 40]
    pool.write_text(head + "\n".join(rows) + "\n")
    assert run("select-seeds", "--pool", pool, "--want", 3, "--out", tmp_path / "seeds.csv") == 0
    seeds = {r.source_id: r for r in read("seeds.csv")}
    assert set(seeds) == {"toy-bbbbbbbbbb", "toy-dddddddddd", "toy-aaaaaaaaaa"}  # scarcest kind, then score, then hash
    assert (seeds["toy-bbbbbbbbbb"].target_span_start, seeds["toy-bbbbbbbbbb"].target_span_end, seeds["toy-bbbbbbbbbb"].target_span_text) == ("0", "2", "国猪")
    assert {r.split for r in seeds.values()} == {"train"} and seeds["toy-aaaaaaaaaa"].orig_line == "2"
    assert run("select-seeds", "--pool", pool, "--want", 9, "--out", tmp_path / "all.csv") == 0
    assert sorted(r.source_id for r in read("all.csv")) == ["toy-aaaaaaaaaa-1", "toy-aaaaaaaaaa-2", "toy-bbbbbbbbbb", "toy-dddddddddd"]

    forms = tmp_path / "forms.csv"
    forms.write_text("char,replacements\n国,國\n好,好\n猪,豬\n")
    assert run("build-maps", "--seeds", tmp_path / "seeds.csv", "--forms", forms, "--out", tmp_path / "maps") == 0
    table = lambda name: {r.char: r.replacements for r in read(f"maps/{name}.csv")}
    assert table("similar") == {"国": "國", "猪": "豬"} and table("similar_word") == {"国猪": "國豬"}
    assert table("emoji_word") == {"狗狗": "🐶🐶"} and table("leet")["十"] == "10" and len(table("emoji")) == 17
    assert "| 狗 | 3 |" in capsys.readouterr().out  # once in 傻狗, twice in 狗狗

    out, log = tmp_path / "v.csv", tmp_path / "log.json"
    assert run("generate", "--seeds", tmp_path / "seeds.csv", "--maps", tmp_path / "maps", "--rules", "Emoji_Sub,Graph_Similar", "--out", out, "--batch-log", log) == 0
    told = json.loads("".join(r.value for r in spark.read.text(str(log), wholetext=True).collect()))
    assert told["output_rows"] == len(read("v.csv")) == sum(told["output_by_type"].values()) > 0
    assert {r.generation_batch_id for r in read("v.csv")} == {told["generation_batch_id"]}
    assert run("generate", "--seeds", tmp_path / "seeds.csv", "--maps", tmp_path / "maps", "--rules", "Emoji_Sub", "--limit", 1, "--out", tmp_path / "v1.csv") == 0
    assert len({r.source_id for r in read("v1.csv")}) <= 1

    assert run("deliver", "--out", tmp_path / "m.csv") == 2 and run("deliver", "--seeds", tmp_path / "gone.csv", "--out", tmp_path / "m.csv") == 2
    assert run("deliver", "--seeds", pool, "--variants", forms, "--version", "v1", "--kappa", 0.81, "--out", tmp_path / "m.csv") == 0
    got = {r.file: r for r in read("m.csv")}
    assert (got["pool.csv"].rows, got["pool.csv"].role, got["pool.csv"].version, got["pool.csv"].kappa) == ("46", "seeds", "v1", "0.810")
    assert got["pool.csv"].sha256 == hashlib.sha256(pool.read_bytes()).hexdigest() and got["forms.csv"].bytes == str(forms.stat().st_size)

    entries = tmp_path / "entries.csv"
    entries.write_text("date,seed_id,attack_type,text,minutes_spent,difficulty_1to5\n2026-01-01,toy-bbbbbbbbbb,Homo,x,3,2\n2026-01-01,toy-bbbbbbbbbb,Homo,y,3,2\n")
    for _ in range(2):
        assert run("pilot-add", "--log", tmp_path / "plog", "--entries", entries, "--seeds", tmp_path / "seeds.csv", "--variants", tmp_path / "pv") == 0
    rows = spark.read.parquet(str(tmp_path / "pv")).collect()
    assert sorted((r.variant_id, r.text) for r in rows) == [(f"r-toy-bbbbbbbbbb-Homo-0{i}", t) for i, t in zip((1, 2, 3, 4), "xyxy", strict=True)]
    assert {(r.split, r.is_pilot, r.generation_rule_id, r.quality_pass) for r in rows} == {("train", "1", "PILOT-MANUAL", "pending")}


def test_word_candidates_command(spark, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a])
    for name, text in {"w": "target_span_text\n妈\n", "s": "char,syllable,tone_syllable\n妈,ma,ma1\n马,ma,ma3\n蚂,ma,ma1\n", "f": "char,count\n妈,9\n马,50\n蚂,40\n", "c": "text\n马上\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    assert run("word-candidates", "--words", tmp_path / "w.csv", "--sounds", tmp_path / "s.csv", "--freq", tmp_path / "f.csv", "--corpus", tmp_path / "c.csv", "--out", tmp_path / "o.csv") == 0
    assert [(r.word, r.candidate, r.same_tone) for r in tables.read_csv(spark, str(tmp_path / "o.csv")).collect()] == [("妈", "蚂", "true"), ("妈", "马", "false")]
