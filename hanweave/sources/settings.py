"""The settings document: JSON with defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "MaxLengthPreview int, FileConvert struct<DefaultPath:string,TypeFilter:string,FixLabel:string,UnicodeAddBom:boolean>, VocabularyCorrection boolean"
#: The keys above, and the defaults.  Fixed values; ``.aspx`` is what a misspelt entry meant.
DEFAULT_FILTER = "<常用文字檔案|*.txt;*.log;*.ini;*.inf;*.bat;*.cmd;*.srt;*.ass;*.lang>/<常用網頁文件|*.htm;*.html;*.php;*.asp;*.css;*.js>/<音頻文件|*.mp3>"
DEFAULT_LABELS = ".htm|.html|.shtm|.shtml|.asp|.aspx|.php"


def parsed(document: Column) -> Column:
    """Settings as a struct; a filter without ``<`` falls back to the default one."""
    raw = F.from_json(document, SCHEMA)
    given = raw["FileConvert"]["TypeFilter"]
    return F.struct(
        F.coalesce(raw["MaxLengthPreview"], F.lit(6)).alias("max_length_preview"),
        F.coalesce(raw["VocabularyCorrection"], F.lit(False)).alias("vocabulary"),
        F.when(F.contains(given, F.lit("<")), given).otherwise(F.lit(DEFAULT_FILTER)).alias("type_filter"),
        F.transform(F.split(F.coalesce(raw["FileConvert"]["FixLabel"], F.lit(DEFAULT_LABELS)), r"\|"), F.lower).alias("labels"),
        F.coalesce(raw["FileConvert"]["UnicodeAddBom"], F.lit(False)).alias("add_bom"),
    )
