"""DuckDB SQL text of the derived catalogue, shared by the oracle queries.

``CATALOG_CTE`` defines the views ``ent`` (entries) and ``arch`` (archives)
over the ``documents`` table with exactly the rules of
:mod:`zipledger.sources.derived`; each oracle query appends its SELECT.
"""

from zipledger.sources.derived import PART_ROWS

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = "abcdefghijklmnopqrstuvwxyz"


def fold(expr: str) -> str:
    return f"translate({expr}, '{UP}', '{LOW}')"


def uuid_of(expr: str) -> str:
    h = f"md5({expr})"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' "
            f"|| substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


def ext_of(expr: str) -> str:
    """Extension rule of ``os.path.splitext`` on the lower-cased base name."""
    return rf"regexp_extract(lower(split_part({expr}, '/', -1)), '(?s)^\.*[^.].*(\.[^.]*)\z', 1)"


_PART = f"CAST(doc_id // {PART_ROWS} + 1 AS VARCHAR)"
_DOC = "CAST(doc_id AS VARCHAR)"

ENT0 = f"""
ent0 AS (
  SELECT
    '/mnt/' || CASE coalesce(TRY_CAST(NULLIF(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0) % 3
                 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 'e' END
      || '/GoogleTakeout/takeout-' || source || '-'
      || lpad({_PART}, CAST(greatest(3, length({_PART})) AS INTEGER), '0') || '.zip' AS archive_path,
    CASE WHEN lang = 'en' THEN 'IMG_' ELSE 'vid-' END
      || lpad({_DOC}, CAST(greatest(6, length({_DOC})) AS INTEGER), '0')
      || CASE WHEN lang = 'en' THEN '.MP4' WHEN lang = 'fr' THEN '.mov'
              WHEN lang = 'de' THEN '.txt' ELSE '.jpg' END AS file_name,
    doc_id, lang, source,
    CAST(strlen(text) AS BIGINT) AS file_size,
    sha256(text) AS file_hash,
    CAST(doc_id % {PART_ROWS} AS INTEGER) AS entry_ordinal
  FROM documents
)"""

CATALOG_CTE = f"""
WITH {ENT0.strip()},
ent AS (
  SELECT *, lang || '/' || file_name AS path_in_archive, {uuid_of('archive_path')} AS archive_uuid
  FROM ent0
),
arch AS (
  SELECT archive_uuid, upper(split_part(archive_path, '/', 3)) || ':' AS drive,
         split_part(archive_path, '/', -1) AS archive_name, archive_path,
         CAST(SUM(file_size) AS BIGINT) AS file_size
  FROM ent GROUP BY archive_uuid, archive_path
),
ja AS (
  SELECT e.*, a.drive, a.archive_name FROM ent e JOIN arch a USING (archive_uuid)
)
"""


def with_catalog(select_sql: str, extra_ctes: str = "") -> str:
    cte = CATALOG_CTE.rstrip()
    if extra_ctes:
        cte += ",\n" + extra_ctes.strip()
    return cte + "\n" + select_sql.strip()
