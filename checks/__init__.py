"""Queries over the given tables, one per operator, with SQL twins."""


def all_queries():
    from checks import base, crawl, extract, feeds, inspect, match, report, rules, stream  # noqa: F401

    return dict(base.QUERIES), dict(base.SQL)
