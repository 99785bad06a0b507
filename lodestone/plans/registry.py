"""All registered queries of the research corpus, and their SQL."""

from __future__ import annotations

from lodestone.plans import answers, research, wording

QUERIES = {**research.QUERIES, **answers.QUERIES, **wording.QUERIES}
ORACLE_SQL = {**research.ORACLE_SQL, **answers.ORACLE_SQL, **wording.ORACLE_SQL}
