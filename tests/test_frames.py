from brindle.streaming import ingest as S


def test_frames_of_text_and_bytes_with_a_backup(spark, tmp_path):
    lines, files = tmp_path / "lines", tmp_path / "files"
    lines.mkdir()
    files.mkdir()
    (lines / "a.jsonl").write_text('{"id":"1","text":"é"}\n\n{"type":"ping"}\nnot json\n{"data":{"id":"2"}}\n', encoding="utf-8")
    (files / "f1").write_bytes('{"id":"3","text":"ü"}'.encode())
    (files / "f2").write_bytes(b'{"id":"4","text":"\xff"}')
    for name, binary, want in (("lines", False, {"id:1": "é", "id:2": ""}), ("files", True, {"id:3": "ü", "id:4": "\ufffd"})):
        store, backup = f"file://{tmp_path}/{name}-store", f"file://{tmp_path}/{name}-backup"
        S.run_ingest(S.frame_stream(spark, f"file://{tmp_path}/{name}", binary), store, f"file://{tmp_path}/{name}-offsets", backup=backup).awaitTermination()
        for where in (spark.read.parquet(f"{store}/messages"), spark.read.json(backup)):
            assert {r["source_key"]: r["text"] for r in where.collect()} == want
