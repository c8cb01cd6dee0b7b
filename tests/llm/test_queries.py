import re

import __spark_entry__
import corpus_pipeline


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert corpus_pipeline.ORACLE_SQL is None
