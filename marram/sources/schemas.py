"""Schemas of chunks, questions, results and requests."""

from __future__ import annotations

METADATA = (
    "struct<file_path:string,version:string,section:string,heading_path:array<string>,method:string,part:int,api_items_part:int,"
    "method_annotations_part:int,method_signatures_part:int,examples_part:int,table_part:int,event_component:string,file:string,"
    "language:string,parent_id:string,chunk_index:int,prev_chunk_id:string,next_chunk_id:string,start_line:int,end_line:int,attrs:map<string,string>>"
)
CHUNK = f"id string, content string, source string, metadata {METADATA}"
RETRIEVAL_QUESTION = "id string, query string, relevant_chunk_ids array<string>, category string, expected_answer_points array<string>"
QUESTION = "id string, question string, category string, expected_answerable boolean, expected_sources array<string>, expected_concepts array<string>"
RESULT = (
    "model string, model_name string, retrieval string, questions_count int, metrics map<string,double>, "
    "results array<struct<id:string,query:string,category:string,relevant_chunk_ids:array<string>,rank:int>>"
)
EMBEDDING = "chunk_id string, embedding array<float>, model string, source string"
ASK = "question string, context string"
ANSWER = "answer string, sources array<struct<id:string,type:string,file:string,section:string,method:string,start_line:int,end_line:int>>"
