"""A small dictionary of our own and texts made of its words, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: entry_id, trad, simp, pinyin, senses_raw
ENTRIES: list[tuple[int, str | None, str | None, str | None, str | None]] = [
    (1, "我", "我", "wo3", "/I; me/"), (2, "他", "他", "ta1", "/he; him/"), (3, "在", "在", "zai4", "/at; in/to exist/"),
    (4, "的", "的", "de5", "/(marks possession)/"), (5, "大", "大", "da4", "/big; great/"), (6, "學", "学", "xue2", "/to learn/"),
    (7, "生", "生", "sheng1", "/to be born/raw; uncooked/"), (8, "學生", "学生", "xue2 sheng5", "/student/CL:個|个[ge4],名[ming2]/"),
    (9, "大學", "大学", "da4 xue2", "/university; college/CL:所[suo3]/"), (10, "大學生", "大学生", "da4 xue2 sheng1", "/university student/"),
    (11, "生活", "生活", "sheng1 huo2", "/life/to live/"), (12, "國", "国", "guo2", "/country; nation/CL:個|个[ge4]/used after the number/"),
    (13, "難", "难", "nan2", "/difficult; hard/"), (14, "國難", "国难", "guo2 nan4", "/national calamity/"), (15, "家", "家", "jia1", "/home; family/CL:個|个[ge4]/"),
    (16, "毀", "毁", "hui3", "/to destroy/"), (17, "大義", "大义", "da4 yi4", "/righteousness/"), (18, "不容", "不容", "bu4 rong2", "/not to allow/"),
    (19, "不", "不", "bu4", "/no; not/"), (20, "容", "容", "rong2", "/to hold/to allow/"), (21, "不容置疑", "不容置疑", "bu4 rong2 zhi4 yi2", "/beyond doubt; see 不容[bu4 rong2]/"),
    (22, "研究", "研究", "yan2 jiu1", "/research/CL:項|项[xiang4]/"), (23, "研究生", "研究生", "yan2 jiu1 sheng1", "/graduate student/"), (24, "生命", "生命", "sheng1 ming4", "/life (as of a living thing)/"),
    (25, "起源", "起源", "qi3 yuan2", "/origin/"), (26, "命", "命", "ming4", "/life; fate/"), (27, "中華人民共和國", "中华人民共和国", "Zhong1 hua2 Ren2 min2 Gong4 he2 guo2", "/(a state); see 共和國|共和国[gong4 he2 guo2]/"),
    (28, "中華", "中华", "Zhong1 hua2", "/China (as in 中國|中国[Zhong1 guo2])/"), (29, "人民", "人民", "ren2 min2", "/the people/"), (30, "共和國", "共和国", "gong4 he2 guo2", "/republic/"),
    (31, "共和", "共和", "gong4 he2", "/republicanism/"), (32, "女", "女", "nu:3", "/woman; see also 女[nu:3]/"), (33, "綠", "绿", "lu:4", "/green/"),
    (34, "長", "长", "chang2", "/long/length/"), (35, "長", "长", "zhang3", "/chief; elder/to grow/"), (36, "椿", "桩", "zhuang1", "/variant of 樁|桩[zhuang1]/"),
    (37, "樁", "桩", "zhuang1", "/stake; post/CL:根[gen1]/"), (38, "安", "安", "An1", "/surname [An1]/"), (39, "兒", "儿", "r5", "/(suffix) ;  ; /"),
    (40, "個", "个", "ge4", "/(measure word)/"), (41, "狗", "狗", "gou3", "/dog/CL:隻|只[zhi1],條|条[tiao2]/"), (42, "空", "空", "kong1", "// /"),
    (43, "缺", "缺", None, "/dropped, as a column is null/"), (44, None, "無", "wu2", "/dropped as well/"),
]

#: What texts are made of: words of the dictionary, words that it lacks, marks and blanks.
TOKENS = ["我", "在", "大学", "大学生", "生活", "研究生命起源", "。", "，", "们", "中华人民共和国", " ", "國難", "毁家", "纾", "！", "？", "不容置疑", "a", "大义不容辞", "々", "　", "绿", "长", "x1"]
PIECES = 12


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "entry_id long, trad string, simp string, pinyin string, senses_raw string")


def _sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def dictionary_sql() -> str:
    rows = ", ".join("(" + ", ".join([str(e[0]), *map(_sql_text, e[1:])]) + ")" for e in ENTRIES)
    return f"dict_raw AS (SELECT * FROM (VALUES {rows}) AS t(entry_id, trad, simp, pinyin, senses_raw))"


def han_text(doc_id: Column) -> Column:
    """A text made from an id by arithmetic."""
    of = F.array(*map(F.lit, TOKENS))
    return F.concat(*[F.get(of, ((doc_id * 7 + doc_id * k + k * 13) % len(TOKENS)).cast("int")) for k in range(PIECES)])


def han_documents(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", han_text(F.col("doc_id")).alias("text"))


def han_sql(table: str = "documents", key: str = "doc_id") -> str:
    of = "[" + ", ".join(map(_sql_text, TOKENS)) + "]"
    pieces = " || ".join(f"({of})[1 + ({key} * 7 + {key} * {k} + {k} * 13) % {len(TOKENS)}]" for k in range(PIECES))
    return f"han AS (SELECT {key} AS doc_id, {pieces} AS text FROM {table})"
