"""Work that is done once for each row or key, however often its result is used."""

import pandas as pd
import pytest

from sessionmine.plans import failures as fl
from sessionmine.sources import replies
from sessionmine.streaming.stateful import PreventionSettler, ReflectTrigger, RepeatSuppressor


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_templates_are_made_once_after_rows_are_spread(spark):
    """The filter on the template ran all patterns below the shuffle as well."""
    rows = spark.createDataFrame([(i, "s", "Timeout on port :3000 after 12.5 s" if i % 3 else [" ", None][i % 2]) for i in range(12)],
                                 "seq long, session_id string, message string").repartition(3, "seq")
    got = fl.fingerprinted(rows)
    plan = _plan(got)
    assert plan.count("UUID") == 1 and plan.index("UUID") < plan.index("RepartitionByExpression")
    assert {r.seq for r in got.collect()} == {i for i in range(12) if i % 3}
    assert fl.fingerprinted(got.drop("fingerprint")).count() == 8  # a template that is there is replaced


def test_replies_are_cut_and_parsed_once(spark):
    """Each filter cut and parsed the reply again for itself."""
    secret = "password=" + "hunter2secret"
    d = spark.createDataFrame([("a", 'x {"title": "T", "facts": [{"text": "one"}, null, {"text": " "}, {"text": "' + secret + '"}]} y'), ("b", "{no\n}"), ("c", "none"), ("d", None)],
                              "session_id string, text string")
    got = replies.ingest_model_output(d)
    for name in ("rejects", "facts", "episodes"):
        plan = _plan(got[name])
        assert plan.count("regexp_extract(text") == 1 and plan.lower().count("parsejson") <= 1, name
    assert {tuple(r) for r in got["rejects"].collect()} == {("b", "not_json"), ("c", "no_object"), ("d", "not_json")}
    facts = [r.text for r in got["facts"].collect()]
    assert len(facts) == 2 and "one" in facts and not any("hunter2" in t for t in facts)


class _State:
    def __init__(self, calls):
        self.calls, self.rows, self.value = calls, {}, None

    def __getattribute__(self, name):
        if name.startswith("_") or name in ("calls", "rows", "value"):
            return object.__getattribute__(self, name)
        self.calls.append(name)
        return {"containsKey": lambda k: k in self.rows, "getValue": lambda k: self.rows[k], "updateValue": self.rows.__setitem__,
                "removeKey": lambda k: self.rows.pop(k), "iterator": lambda: iter(list(self.rows.items())),
                "clear": lambda: (self.rows.clear(), setattr(self, "value", None)), "exists": lambda: self.value is not None,
                "get": lambda: self.value, "update": lambda v: setattr(self, "value", v)}[name]


class _Handle:
    def __init__(self):
        self.calls = []

    def getMapState(self, *_):
        return _State(self.calls)

    getValueState = getMapState

    def registerTimer(self, _):
        pass

    deleteTimer = registerTimer


def _given(processor, frames):
    handle = _Handle()
    processor.init(handle)
    out = pd.concat([o for f in frames for o in processor.handleInputRows(("s",), iter([f]), None)])
    return sorted(map(tuple, out.itertuples(index=False))), len(handle.calls)


KINDS = ["once", "repeat", "advisory", "once", "delivery", "first_contact", "delivery", "compaction", "once", "consulted", "delivery", "advisory", "session/disposed"]
SETTLED = ["warning", "observe", "turn_end", "warning", "turn_end", "warning", "turn_end"]


@pytest.mark.parametrize("make, kinds", [(lambda: RepeatSuppressor(4, 3, 5, 2), KINDS), (lambda: PreventionSettler(3), SETTLED)])
def test_a_batch_reads_the_state_once_for_each_key(make, kinds):
    """What rows one by one give, in few calls to the state store: there were up to three a row."""
    n = 195
    rows = pd.DataFrame({"seq": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), "min"), "turn": [i // 7 for i in range(n)],
                         "kind": [kinds[(i * i + i // 5) % len(kinds)] for i in range(n)], "item_id": [f"w{i * 7 % 4}" for i in range(n)],
                         "fingerprint": [f"f{i * 5 % 4}" for i in range(n)], "content_hash": [str(i // 60) for i in range(n)]})
    one_by_one, _ = _given(make(), [rows.iloc[i:i + 1] for i in range(n)])
    parts, _ = _given(make(), [rows.iloc[i:i + 40] for i in range(0, n, 40)])
    whole, _ = _given(make(), [rows])
    assert one_by_one == parts == whole and len(whole) > 5
    plain = rows[~rows["kind"].isin(["compaction", "session/disposed"])]
    assert _given(make(), [plain])[1] < 60


@pytest.mark.parametrize("shared", [False, True])
def test_a_reflection_batch_reads_and_writes_each_state_once(shared):
    """Every read asked first whether there was something: six calls a batch."""
    n = 60
    rows = pd.DataFrame({"seq": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), "min"), "turn": range(n),
                         "kind": [["turn_end", "result", "turn_end", "skipped"][i * i % 7 % 4] for i in range(n)], "signal": [i % 3 == 0 for i in range(n)],
                         "correction": [i % 11 == 5 for i in range(n)], "novelty": [i % 9 / 10 for i in range(n)], "new_ground": [i % 13 == 6 for i in range(n)],
                         "created": [i % 4 // 3 for i in range(n)], "empty_streak": [i % 5 for i in range(n)]})
    make = lambda: ReflectTrigger(3, 0.15, 2, shared)
    whole, calls = _given(make(), [rows.iloc[::-1]])
    parts, more = _given(make(), [rows.iloc[i:i + 15] for i in range(0, n, 15)])
    assert whole == parts == _given(make(), [rows.iloc[i:i + 1] for i in range(n)])[0] and len({r[4] for r in whole}) > 4
    assert calls <= 4 and more <= 4 * 4
