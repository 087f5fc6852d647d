"""SCL1-SCL4, SCL16: keys and links from URLs and raw-page paths."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ACT_PATH, ELI_URL, INDEX_LINK, PRINT_PATH, YEAR_INDEX_PATH


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _int_group(col: Column, pattern: str, group: int) -> Column:
    g = F.regexp_extract(col, pattern, group)
    return F.when(g != "", g.try_cast("int"))


def url_year(url) -> Column:
    """SCL1: year of ``/eli/{year}/act/{n}/`` (search, not full match); NULL if absent."""
    return _int_group(_c(url), ELI_URL, 1)


def url_act_number(url) -> Column:
    """SCL1: act number of ``/eli/{year}/act/{n}/``; NULL if absent."""
    return _int_group(_c(url), ELI_URL, 2)


def url_path_year(url) -> Column:
    """SCL4: the third path piece from the end (``split('/')[-3]``); NULL if there are fewer."""
    return F.try_element_at(F.split(_c(url), "/"), F.lit(-3))


def path_year(path) -> Column:
    """SCL2: 4-digit year folder of ``.../{yyyy}/act_{n}.html``; NULL if no match."""
    return _int_group(_c(path), ACT_PATH, 1)


def path_act_number(path) -> Column:
    """SCL2: act number of ``.../{yyyy}/act_{n}.html``; NULL if no match."""
    return _int_group(_c(path), ACT_PATH, 2)


def print_url(base: str, year, number) -> Column:
    """Absolute print URL of an act (``urljoin`` of an absolute path)."""
    a, rest = PRINT_PATH.split("{year}")
    b, c = rest.split("{number}")
    return F.concat(F.lit(base.rstrip("/") + a), _c(year).cast("string"), F.lit(b),
                    _c(number).cast("string"), F.lit(c))


def link_transform(link, year, base: str) -> Column:
    """SCL3: ``.../{n}/index.html`` -> print URL of act ``int(n)`` of ``year``; else NULL."""
    n = _int_group(_c(link), INDEX_LINK, 1)
    return F.when(n.isNotNull(), print_url(base, year, n))


def year_index_url(base: str, year) -> Column:
    """SRC5: the per-year index page to start a crawl from."""
    a, b = YEAR_INDEX_PATH.split("{year}")
    return F.concat(F.lit(base.rstrip("/") + a), _c(year).cast("string"), F.lit(b))


def empty_to_null(col) -> Column:
    """SCL16: ``''`` -> NULL."""
    return F.nullif(_c(col), F.lit(""))
