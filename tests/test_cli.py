import pytest

from stowage import cli
from stowage.streaming import arrivals


def run(capsys, *args):
    code = cli.main(list(map(str, args)))
    return code, capsys.readouterr().out


def test_pack_list_validate_unpack(spark, tmp_path, capsys):
    src = tmp_path / "src"
    (src / "Sound").mkdir(parents=True)
    (src / "a b.txt").write_bytes(b"hello" * 20)
    (src / "Sound/x.wav").write_bytes(b"wave" * 300)
    out = tmp_path / "made.ba2"
    assert run(capsys, "pack", src, out, "--format", "ba2-gnrl-fo4", "--compress", "compressed", "-j", "auto")[0] == 0
    assert run(capsys, "pack", src, out, "--format", "ba2-gnrl-fo4")[0] == 1  # exists
    code, text = run(capsys, "list", out, "--details")
    assert code == 0 and [x.split("\t")[0] for x in text.splitlines()] == ["a b.txt", "sound/x.wav"]
    code, text = run(capsys, "validate", out)
    assert code == 0 and "compressed_sound_payload" in text and text.endswith("valid\n")
    assert run(capsys, "validate", out, "--strict", "--family", "bsa")[0] == 1
    assert "version: 1" in run(capsys, "info", out)[1]
    code, text = run(capsys, "unpack", out, tmp_path / "x", "--path", "SOUND\\X.wav", "--path", "none", "--workers", "2")
    assert code == 1 and "1 extracted, 1 failed" in text and (tmp_path / "x/sound/x.wav").read_bytes() == b"wave" * 300
    (tmp_path / "junk.ba2").write_bytes(b"junk")
    assert run(capsys, "info", tmp_path / "junk.ba2")[0] == 1
    q = arrivals.keep_catalog(arrivals.arriving(spark, str(tmp_path / "*.ba2")), str(tmp_path / "catalog"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "catalog")).where("kind = 'entry'").count() == 2


def test_usage():
    for args in ([], ["pack", "a", "b"], ["unpack", "a", "b", "--workers", "-1"], ["pack", "a", "b", "--format", "zip"]):
        with pytest.raises(SystemExit) as e:
            cli._parser().parse_args(args)
        assert e.value.code == 2
