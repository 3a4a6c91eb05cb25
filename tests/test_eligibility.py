"""Rules on targets, inputs and goals, each tried on both sides of its limit."""

import pytest

from tabloom.contracts import ColumnType, ExperimentSpec, Task
from tabloom.errors import TableError
from tabloom.operators import eligibility as e
from tabloom.operators import review
from tabloom.operators.override import change_type
from tabloom.operators.profile import column_facts, infer_schema, profile


def cycled(values, n):
    return [values[i % len(values)] for i in range(n)]


def classes(sizes):
    """A class name per row, classes of these sizes."""
    return [f"k{i:02}" for i, n in enumerate(sizes) for _ in range(n)]


def reasons(columns_table, columns, task):
    profiled = profile(column_facts(columns_table(columns), "row_id"))
    return {r["name"]: r["reason"] for r in e.target_reasons(profiled, task).collect()}


@pytest.mark.parametrize("task", [Task.CLASSIFICATION, Task.REGRESSION])
def test_targets_at_the_limits(columns_table, task):
    n, least, most = e.MIN_TARGET_ROWS, e.MIN_CLASS_ROWS, e.MAX_CLASSES
    number = None if task == Task.REGRESSION else "CLASS_SIZE"
    text = "TARGET_NUMBER" if task == Task.REGRESSION else None
    enough = {
        "numbers": [str(3 * i) for i in range(n)], "even": classes([n // 2, n - n // 2]), "smallest": classes([n - least, least]),
        "too_small": classes([n - least + 1, least - 1]), "alone": classes([n]), "gap": ["", *classes([n // 2, n - n // 2 - 1])],
        "fractions": cycled(["0.25", "0.75"], n), "switch": cycled(["True", "FALSE"], n), "day": [f"2031-05-{i % 28 + 1:02}" for i in range(n)],
        "nothing": [""] * n, "item_id": [f"i{i}" for i in range(n)],
    }
    want = {
        "numbers": number, "even": text, "smallest": text, "too_small": text or "CLASS_SIZE", "alone": text or "TARGET_CONSTANT",
        "gap": text or "TARGET_MISSING", "fractions": None if task == Task.REGRESSION else "TARGET_FRACTION", "switch": text,
        "day": "TARGET_TYPE", "nothing": "TARGET_TYPE", "item_id": "TARGET_TYPE",
    }
    assert reasons(columns_table, enough, task) == want
    few = {"numbers": [str(3 * i) for i in range(n - 1)], "even": classes([n // 2, n - 1 - n // 2])}
    assert set(reasons(columns_table, few, task).values()) == ({"TARGET_ROWS"} if text is None else {"TARGET_ROWS", "TARGET_NUMBER"})
    many = {"most": classes([least] * most + [0]) + classes([least]), "beyond": classes([least] * (most + 1))}
    got = reasons(columns_table, many, task)
    assert got == {"most": text, "beyond": text or "CLASS_COUNT"}


@pytest.fixture
def wide(columns_table):
    n = 26
    return columns_table({
        "order_id": [f"o{i}" for i in range(n)], "made": [f"2019-{i % 12 + 1:02}-01" for i in range(n)], "weight": [str(2 * (i % 9)) for i in range(n)],
        "open": cycled(["TRUE", "FALSE"], n), "kind": cycled(["soft", "hard"], n), "same": ["one"] * n, "blank": [""] * n,
        "remark": [f"{i}{'r' * 201}" for i in range(n)],
    })


def test_inputs_and_changed_types(wide):
    schema = infer_schema(wide, "row_id")
    choices = review.Configuration(wide, schema)
    got = {r["name"]: (r["eligible"], r["is_default"], r["reason"]) for r in choices.inputs("classification", "kind").collect()}
    refused = {"order_id": "FEATURE_TYPE", "made": "FEATURE_TYPE", "kind": "IS_TARGET", "same": "CONSTANT", "blank": "CONSTANT"}
    assert got == {n: (False, False, code) for n, code in refused.items()} | {
        "weight": (True, True, None), "open": (True, True, None), "remark": (True, False, "REVIEW"),
    }
    assert choices.defaults("classification", "kind") == ("weight", "open") and choices.defaults("clustering") == ("weight",)
    days = change_type(wide, "row_id", schema, "made", ColumnType.CATEGORY)
    assert "made" in review.Configuration(wide, days).defaults("classification", "kind")


def test_configuration_step_by_step(wide):
    choices = review.Configuration(wide, infer_schema(wide, "row_id"))
    assert {r["task"]: r["reason"] for r in choices.tasks().collect()} == {
        "classification": None, "regression": None, "clustering": None, "reduction": "GOAL_FEATURES",
    }
    targets = {r["name"]: (r["eligible"], r["suggested"]) for r in choices.targets("classification").collect()}
    assert {n for n, (ok, _) in targets.items() if ok} == {n for n, (_, shown) in targets.items() if shown} == {"open", "kind"}
    assert {r["name"] for r in choices.targets("regression").collect() if r["suggested"]} == {"weight"}
    assert choices.bounds("clustering", ["weight"]) == (2, e.MAX_OPTION, e.DEFAULT_GROUPS) and choices.bounds("reduction", ["weight"]) is None
    assert choices.warnings("classification", "kind", ("weight", "open")) == ("DUPLICATE_ROWS",)


@pytest.mark.parametrize("task,rows,features", [
    (Task.CLUSTERING, e.CLUSTERING_ROWS, e.CLUSTERING_FEATURES), (Task.REDUCTION, e.REDUCTION_ROWS, e.REDUCTION_FEATURES),
])
def test_goals_at_the_limits(columns_table, task, rows, features):
    def reason(n, width):
        columns = {f"v{k}": [str(i * (k + 1)) for i in range(n)] for k in range(width)} | {"t": cycled(["p", "q"], n)}
        found = {r["task"]: r for r in e.goal_reasons(profile(column_facts(columns_table(columns), "row_id"))).collect()}[task.value]
        low, high, default = e.option_bounds(task, n, width)
        assert (found["minimum"], found["maximum"], found["default_option"]) == (low, high, default)
        return found["reason"]

    assert reason(rows, features) is None and reason(rows - 1, features) == "GOAL_ROWS"
    if features > 1:
        assert reason(rows, features - 1) == "GOAL_FEATURES"


def test_options_follow_rows_and_inputs():
    for rows in range(3, 16):
        for width in range(2, 14):
            low, high, default = e.option_bounds(Task.REDUCTION, rows, width)
            assert (low, high) == (1, min(e.MAX_OPTION, rows - 1, width - 1)) and low <= default <= high
            assert e.option_bounds(Task.CLUSTERING, rows, width) == (2, min(e.MAX_OPTION, rows - 1), e.DEFAULT_GROUPS)
    assert e.option_bounds(Task.REGRESSION, 100, 3) is None


@pytest.fixture
def answered(columns_table):
    n = 2 * e.MIN_TARGET_ROWS
    answer = cycled(["0", "1"], n)
    return columns_table({"result": answer, "answer": answer, "size": [str(i) for i in range(n)]})


def test_selections_and_their_faults(answered):
    schema = infer_schema(answered, "row_id")

    def spec(task="classification", target="answer", features=("size",), option=None, seen=()):
        return ExperimentSpec(task, target, features, ("m",), option, seen)

    def fault(**changes):
        with pytest.raises(TableError) as caught:
            review.validate_selection(answered, schema, spec(**changes))
        return caught.value.code, caught.value.column

    assert review.validate_selection(answered, schema, spec()) == ()
    leaky = review.review_warnings(answered, schema, spec(features=("result",)))
    assert leaky == ("EQUAL_TARGET:result", "LEAKAGE_NAME:result", "DUPLICATE_ROWS")
    assert review.validate_selection(answered, schema, spec(features=("result",), seen=leaky)) == leaky
    for k in range(3):
        assert fault(features=("result",), seen=leaky[:k]) == ("ACKNOWLEDGEMENT", None)
    assert fault(features=("unheard",)) == fault(target="unheard") == ("COLUMN", "unheard")
    assert fault(option=2) == ("OPTION", None)
    free = {"task": "clustering", "target": None}
    for option in (None, True, 1, e.MAX_OPTION + 1, 2.0):
        assert fault(**free, option=option) == ("OPTION", None)
    assert review.validate_selection(answered, schema, spec(**free, option=2)) == ()
    assert fault(task="reduction", target=None, option=1) == ("FEATURE", None)


def test_rules_of_every_experiment():
    for task, target, features, models in (
        ("classification", "t", ("t",), ("m",)), ("classification", None, ("f",), ("m",)), ("clustering", "t", ("f",), ("m",)),
        ("regression", "t", (), ("m",)), ("regression", "t", ("f", "f"), ("m",)), ("regression", "t", ("f",), ()),
    ):
        with pytest.raises(ValueError, match="SUPERVISED|TARGET|DISTINCT"):
            ExperimentSpec(task, target, features, models)


def test_values_equal_across_types(columns_table):
    df = columns_table({"yes": ["false", "true", "", "TRUE"], "one": ["0", "1", "", "1.0"], "word": ["0", "1", "", "1"]})
    types = {"yes": ColumnType.BOOLEAN, "one": ColumnType.NUMBER, "word": ColumnType.CATEGORY}
    got = {r["name"]: r["equal"] for r in review.equal_to_target(df, types, "one", ["yes", "word"]).collect()}
    assert got == {"yes": True, "word": False}
