from brindle.plans import mentions as N


def test_registered_handles_become_company_names(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("companies", [("c1", "英伟达", "NASDAQ", "NVDA", "Nvidia", "", "")], "company_id string, company_name string, exchange string, ticker string, aliases string, brands string, negative_contexts string")
    write("binance_tradfi_instruments", [("NYSE:PLTR", "US", "NYSE", "PLTR", "Palantir", "", "stock", 1)], "canonical_code string, market string, exchange string, ticker string, name_en string, name_cn string, asset_type string, mapper_candidate int")
    write("messages", [(1, "by @Nvidia and @someone")], "id long, text string")
    assert N.sanitize_text(spark, str(tmp_path)).first()["text"] == "by 英伟达 and [HANDLE]"
