import json

from tidemark.__main__ import main


def call(capsys, spark, *words):
    assert main(words, spark) == 0
    return json.loads(capsys.readouterr().out)


def test_load_list_compact(spark, tmp_path, capsys):
    entity = {"type": "application", "slug": "app"}
    rows = [{"id": n % 20, "title": f"t{n}", "service_id": 1, "start_time": 3600 * n, "finish_time": 3600 * n + 60, "created_at": n, "components": ["prod"], "resource_manager_entity": entity} for n in range(30)]
    (tmp_path / "dump.json").write_text("\n".join(map(json.dumps, [*rows, {"id": 99, "title": "no service"}])))
    store = f"{tmp_path}/store"
    load = ("load", "--store", store, "--input", f"{tmp_path}/dump.json", "--batches", "3")
    assert call(capsys, spark, *load)["events"] == 20
    assert call(capsys, spark, *load)["events"] == 20  # told again, nothing is added
    request = {"page_size": 12, "page_token": "", "start_time": "1970-01-01T00:00:00.000Z", "end_time": "1970-01-01T19:00:00+01:00", "filter": '(tags = "prod" AND annotations.resource_external_id = "app")'}
    seen = []
    while True:
        (tmp_path / "request.json").write_text(json.dumps(request))
        page = call(capsys, spark, "list", "--store", store, "--request", f"{tmp_path}/request.json")
        seen += [e["title"] for e in page["events"]]
        request["page_token"] = page["next_page_token"]
        if not request["page_token"]:
            break
    assert seen == [f"t{n}" for n in range(18, -1, -1)]
    assert page["stats"]["pending_count"] == 3
    assert call(capsys, spark, "compact", "--store", store)["level_cardinalities"]["1"] == 20
    assert call(capsys, spark, "stats", "--store", store)["pending_count"] == 0
