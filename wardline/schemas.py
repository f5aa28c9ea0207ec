"""Explicit schemas of the sources."""

MESSAGE = "struct<role:string,content:string,name:string>"
MESSAGES = f"array<{MESSAGE}>"

REQUEST_LOG = f"""timestamp timestamp, user_id string, session_id string, request_id string, model string,
messages {MESSAGES},
parameters struct<temperature:double,top_p:double,max_tokens:int,stream:boolean,stop:array<string>,presence_penalty:double,frequency_penalty:double,enable_context:boolean,max_context_turns:int,user_id:string>,
api_key string, response_time double, tokens_used bigint, response_content string, finish_reason string,
error string, with_context boolean, context_turns int"""

TURN = """timestamp:string,request_id:string,user_message:string,assistant_response:string,model:string,
tokens_used:bigint,response_time:double,finish_reason:string"""
SESSION = f"""struct<session_id:string,user_id:string,created_at:string,last_active:string,
total_turns:bigint,total_tokens:bigint,conversation_turns:array<struct<{TURN}>>>"""
USER = """struct<user_id:string,total_sessions:bigint,total_turns:bigint,total_tokens:bigint,
active_sessions:array<string>,last_active:string>"""
STORE = f"sessions map<string,{SESSION}>, users map<string,{USER}>"

KEY = "struct<created_at:timestamp,last_used:timestamp,usage_count:bigint,description:string,enabled:boolean>"
REGISTRY = "key string, created_at timestamp, last_used timestamp, usage_count bigint, description string, enabled boolean"

QUESTION_ANSWER = "question string, answer string"
CONVERSATIONS = "array<array<struct<role:string,content:string>>>"

STREAM_LINE = "request_id string, seq int, line string, ts timestamp"
