"""The registry survives missing optional parts, and nothing else that is broken."""

from __future__ import annotations

import builtins
import sys

import pytest

import __spark_entry__ as contract


@pytest.mark.parametrize("missing", ["ahocorasick", "public_tokenizers", "boxlake.llm", "corpus_pipeline", "numpy"])
def test_missing_packages(monkeypatch, missing):
    from boxlake.plans.queries import ORACLES, QUERIES

    for name in list(sys.modules):
        if name.startswith("boxlake.llm") or name in ("corpus_pipeline", "ahocorasick", "public_tokenizers"):
            monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def fake(name, *rest):
        if name == missing or name.startswith(f"{missing}."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *rest)

    monkeypatch.setattr(builtins, "__import__", fake)
    if missing == "numpy":  # a dependency of everything is no optional part
        with pytest.raises(ModuleNotFoundError):
            contract._corpus()
        return
    found, sql = contract.queries(), contract.oracle_sql()
    assert set(QUERIES) <= set(found) and set(ORACLES) <= set(sql)
    assert "pipeline" not in found and set(sql) <= set(found)
