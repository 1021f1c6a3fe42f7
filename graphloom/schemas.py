"""Explicit schemas; none is ever inferred."""

POINT_LIST = "array<string>"
SECTION = f"struct<section_order:int,section_name:string,knowledge_points:{POINT_LIST}>"
CHAPTER = f"struct<chapter_order:int,chapter_name:string,sections:array<{SECTION}>>"
CATALOGUE = f"subject string, stage string, grade string, semester string, publisher string, edition string, source_url string, chapters array<{CHAPTER}>"
CONCEPT = "struct<uri:string,label:string,description:string>"
EXAM = "id string, Questions array<struct<type:string,passage:string,question:string,choices:array<string>,answers:array<string>>>"
TRIPLE = "s string, p string, o string"
