"""The registered queries of the jobs and the DuckDB SQL of their whole output."""

from __future__ import annotations

from . import analyse_code, text_index

QUERIES = {f.__name__: f for f in (text_index.job1_text_index, analyse_code.job2_analyse_code)}
SQL = {"job1_text_index": text_index.SQL, "job2_analyse_code": analyse_code.SQL}
