"""Schemas of the tables that stages exchange."""

from __future__ import annotations

NODE = "struct<id:int,text:string,type:string,up_id:int,down_ids:array<int>,span_start:int,span_end:int,level:int,subtree_end:int>"
PAGE = "title string, text string"
TREE = f"title string, num_nodes int, nodes array<{NODE}>, full_text string"
VERTEX = "title string, intro string, embedding array<float>, degree int"
EDGE = "src string, dst string"
QUESTION = "qid string, question string, pre_retrieved_passages array<struct<title:string,text:string>>"
HOP = (
    "qid string, root string, hop int, rank int, title string, source_title string, adjacent_score double,"
    " local_score double, global_score double, total_score double, softmax_score double, degree int"
)
MEDIAWIKI = "title string, revision array<struct<text:string>>"
#: Question column of each data set.
QUESTION_COLUMN = {"asqa": "ambiguous_question", "eli5": "title", "qampari": "question_text", "generic": "question"}


def dataset_of(path: str) -> str:
    """The data set whose name the path contains; else generic."""
    lower = path.lower()
    return next((d for d in QUESTION_COLUMN if d in lower), "generic")
