"""All registered queries and the SQL they are compared with."""

from citelode.plans import answers, checks, datasets, documents, evaluation, experiments, history, matrix, retrieval, tokens

_AREAS = (documents, retrieval, answers, evaluation, experiments, datasets, history, checks, tokens, matrix)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _area in _AREAS:
    QUERIES.update(_area.QUERIES)
    ORACLES.update(_area.ORACLES)
