"""Views over the driver's tables that give them the shape of corpora, logs and evaluations.

Each view is plain SQL that both engines read; what is under test are the
operators applied to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sortflow.workload.registry import table

VIEWS = {
    "corpus": (
        "documents",
        """
        select doc_id, source, lang, text as content,
          case when doc_id % 11 = 0 then ''
               else source || '_' || cast(doc_id as string) || '.' ||
                 case doc_id % 10 when 0 then 'txt' when 1 then 'py' when 2 then 'log' when 3 then 'jpg'
                   when 4 then 'zip' when 5 then 'md' when 6 then 'tar.gz' when 7 then 'csv' when 8 then 'JPG'
                   else 'tmp' end end as filename,
          case lang when 'en' then 'Docs' when 'de' then 'Finance' when 'fr' then 'Study' else 'Logs' end as label
        from {documents}
        """,
    ),
    "raw_pages": (
        "pages",
        "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, url, html from {pages}",
    ),
    "scored": (
        "documents",
        """
        select doc_id, row_index, filename, content, y_true, y_pred, p_pred,
          case when y_true = y_pred then p_pred else (1 - p_pred) / 2 end as p_true
        from (select doc_id, doc_id as row_index, source || '.txt' as filename, text as content,
                case lang when 'en' then 'Docs' when 'de' then 'Finance' when 'fr' then 'Study' else 'Logs' end
                  as y_true,
                case when doc_id % 7 = 0
                     then case lang when 'en' then 'Finance' when 'de' then 'Study' when 'fr' then 'Logs' else 'Docs' end
                     else case lang when 'en' then 'Docs' when 'de' then 'Finance' when 'fr' then 'Study' else 'Logs' end
                end as y_pred,
                0.5e0 + cast((doc_id * 37) % 499 as double) / 1000 as p_pred
              from {documents}) t
        """,
    ),
    "scored_again": (
        "documents",
        """
        select doc_id,
          case lang when 'en' then 'Docs' when 'de' then 'Finance' when 'fr' then 'Study' else 'Logs' end as y_true,
          case when doc_id % 5 = 0
               then case lang when 'en' then 'Finance' when 'de' then 'Finance' when 'fr' then 'Logs' else 'Docs' end
               else case lang when 'en' then 'Docs' when 'de' then 'Finance' when 'fr' then 'Study' else 'Logs' end
          end as y_pred
        from {documents}
        """,
    ),
    "ops": (
        "events",
        """
        select event_id as id, user_id as owner, case when event_type = 'error' then 'undo' else 'move' end as op,
          case event_type when 'signup' then 'Docs' when 'click' then 'Code' when 'view' then 'Media'
            when 'purchase' then 'Finance' end as category,
          value / 500 as confidence,
          '/in/' || cast(user_id as string) || '/f' || cast(event_id % 40 as string) || '.txt' as src, ts
        from {events}
        """,
    ),
    "history": (
        "part",
        """
        select p_partkey % 50 as run, cast(floor(p_partkey / 50) as int) + 1 as epoch,
          p_retailprice / 10000 as val_macro_f1
        from {part}
        """,
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = VIEWS[name]
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


def with_views(*names: str) -> str:
    """``with`` clause that defines the views in SQL."""
    parts = []
    for name in names:
        source, text = VIEWS[name]
        parts.append(f"{name} as ({text.format(**{source: source})})")
    return "with " + ", ".join(parts)
