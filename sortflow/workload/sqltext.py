"""SQL fragments shared by the oracle texts."""

from __future__ import annotations

from sortflow.functions.text import WHITESPACE


def norm(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '[\x00{WHITESPACE}]+', ' ', 'g'))"


def collapse(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '[{WHITESPACE}]+', ' ', 'g'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[{WHITESPACE}]+|[{WHITESPACE}]+\z', '', 'g')"


def base_name(c: str) -> str:
    cut = rf"regexp_extract(regexp_replace({c}, '(/\.?)+\z', ''), '[^/]*\z')"
    return f"case when {cut} = '.' then '' else {cut} end"


def stem(n: str) -> str:
    return rf"(case when regexp_matches({n}, '(?s)^.+\.[^.]+\z') then regexp_extract({n}, '(?s)^(.+)\.[^.]+\z', 1) else {n} end)"


def ext(n: str) -> str:
    return rf"regexp_extract({n}, '(?s)^.+\.([^.]+)\z', 1)"


def featurize(p: str) -> str:
    n = f"({base_name(f'lower({p})')})"
    words = f"translate({stem(n)}, '_-', '  ')"
    return f"(case when {ext(n)} <> '' then {words} || ' EXT_' || {ext(n)} else {words} end)"


def suffixes(p: str) -> str:
    n = f"({base_name(f'lower({p})')})"
    return (
        f"(case when {n} like '%.' then [] else list_transform("
        rf"list_slice(string_split(regexp_replace({n}, '^\.+', ''), '.'), 2, 1000000), lambda s: '.' || s) end)"
    )


def rule(p: str) -> str:
    found = suffixes(p)

    def hit(names: str) -> str:
        return f"list_has_any({found}, [{names}])"

    media = "'.jpg','.jpeg','.png','.gif','.bmp','.webp','.mp4','.avi','.mov','.mkv','.mp3','.wav','.flac'"
    archives = "'.zip','.rar','.7z','.tar','.gz','.bz2','.xz'"
    code = "'.py','.js','.ts','.java','.cpp','.go','.sql','.sh'"
    return (
        f"(case when {hit(media)} then 'Media' when {hit(archives)} then 'Archives' "
        f"when {hit(code)} then 'Code' when {hit(chr(39) + '.log' + chr(39))} then 'Logs' end)"
    )


ICON = (
    "(case {c} when 'Code' then '💻' when 'Docs' then '📄' when 'Finance' then '💰' when 'Study' then '📚' "
    "when 'Media' then '🎬' when 'Archives' then '📦' when 'Logs' then '📋' else '📂' end)"
)


def icon(c: str) -> str:
    return ICON.format(c=c)


def hash_rank(partition: str, id_col: str) -> str:
    by = f"partition by {partition} " if partition else ""
    return f"row_number() over ({by}order by md5('42:' || cast({id_col} as varchar)), {id_col})"
