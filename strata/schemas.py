"""Schemas of the tables that the operators read and write."""

MEMORY_ITEM = "id string, session_id string, type string, content string, created_at timestamp, importance double, metadata map<string,string>, source_ids array<string>, compressed_from string, status string"
EPISODE = "id string, session_id string, content string, summary string, importance double, event_type string, created_at timestamp, metadata string"
RELATION = "source_id string, target_id string, relation_type string"
RAG_DOCUMENT = "id string, name string, format string, size bigint, chunk_count int, status string, sha256 string, created_at timestamp"
RAG_CHUNK = "id string, doc_id string, chunk_index int, content string, token_est int, start_pos int, end_pos int, metadata string, created_at timestamp"
CHUNK = "array<struct<index:int,content:string,token_est:int,start_pos:int,end_pos:int>>"
NODE = "id string, tags array<string>, properties map<string,string>"
NOTE = "id string, title string, type string, tags array<string>, created_at timestamp, updated_at timestamp, content string"
PACKET = "content string, timestamp timestamp, token_count bigint, relevance double, source string, memory_type string"
EVENT_TYPES = ("task", "conversation", "observation", "decision", "error")
NOTE_TYPES = ("general", "task_state", "conclusion", "blocker", "action", "reference")
PACKET_SOURCES = ("system", "memory", "rag", "history", "note", "custom")
