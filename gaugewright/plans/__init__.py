"""The catalogue of queries over the test tables, each with its SQL."""


def catalogues() -> list:
    """All catalogues of queries."""
    from gaugewright.plans import evaluation, statistics, tables

    return [evaluation.catalogue, statistics.catalogue, tables.catalogue]
