"""The module of queries: no name of it is taken twice, so that no query calls another's helper."""

import ast
import inspect
from collections import Counter

from quire import queries


def test_no_name_is_defined_twice():
    names = Counter(x.name for x in ast.parse(inspect.getsource(queries)).body if isinstance(x, ast.FunctionDef))
    assert [n for n, k in names.items() if k > 1] == []
