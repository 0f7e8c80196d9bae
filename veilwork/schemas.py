"""Column types of the contract, as DDL text."""

# one entry of a token-classification response
ENTITY = (
    "struct<entity_group:string,entity:string,score:double,word:string,start:int,end:int>"
)
ENTITIES = f"array<{ENTITY}>"

# the form in which entities are listed to the user
LISTED = "struct<type:string,text:string,start:int,end:int,confidence:double>"
LISTED_ENTITIES = f"array<{LISTED}>"

# one entry of a text-classification response
LABEL = "struct<label:string,score:double>"
LABELS = f"array<{LABEL}>"

# a rule match before overlaps are joined; field order is sort order
SPAN = "struct<start:int,prio:int,end:int,label:string,score:double,word:string>"
SPANS = f"array<{SPAN}>"

# what a model scorer adds to each row
MODEL_FIELDS = "response string, latency_seconds double, error string, status string"
