import json

import pytest

from vodlens.plans import catalog, rpc


@pytest.fixture(scope="module")
def desk(spark, data):
    return rpc.Dispatcher(spark, data, catalog.queries())


def test_every_method_has_a_query():
    assert set(rpc.METHODS.values()) <= set(catalog.queries())


def test_rows_are_filtered_and_paged(desk):
    got = json.loads(desk.handle_line('{"jsonrpc": "2.0", "id": 1, "method": "harvest.getStatus", "params": {"where": {"o_orderstatus": "F"}, "limit": 5}}'))
    assert got["id"] == 1 and [r["o_orderstatus"] for r in got["result"]["rows"]] == ["F"]
    page = desk.handle({"method": "trigger_times", "params": {"limit": 3, "offset": 2}})["result"]["rows"]
    assert len(page) == 3


@pytest.mark.parametrize("line, code", [("{", rpc.PARSE), ("[]", rpc.INVALID), ('{"method": "nothing"}', rpc.NO_METHOD), ('{"method": "ping", "params": [1]}', rpc.BAD_PARAMS), ('{"method": "status_counts", "params": {"where": {"x": 1}}}', rpc.BAD_PARAMS)])
def test_errors(desk, line, code):
    assert json.loads(desk.handle_line(line))["error"]["code"] == code


def test_handlers(desk):
    assert desk.handle({"method": "ping"})["result"] == {"status": "ok"}
    desk.register("echo", lambda p: p)
    assert desk.handle({"method": "echo", "params": {"a": 1}})["result"] == {"a": 1}
    desk.register("broken", lambda p: 1 / 0)
    assert desk.handle({"method": "broken"})["error"]["code"] == rpc.INTERNAL
