"""Payment-gateway replies: nested JSON to columns, with the size and unknown-field checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reply's shape.

LOG = (
    "struct<start_time:bigint,time_spent:bigint,attempts:bigint,errors:bigint,success:boolean,"
    "mobile:boolean,input:array<string>,history:array<struct<type:string,message:string,time:bigint>>>"
)
AUTHORIZATION = (
    "struct<authorization_code:string,bin:string,last4:string,exp_month:string,exp_year:string,"
    "channel:string,card_type:string,bank:string,country_code:string,brand:string,"
    "reusable:boolean,signature:string,account_name:string>"
)
CUSTOMER = (
    "struct<id:bigint,first_name:string,last_name:string,email:string,customer_code:string,"
    "phone:string,metadata:string,risk_action:string,international_format_phone:string>"
)
DATA = (
    "struct<id:bigint,authorization_url:string,paused:boolean,domain:string,status:string,"
    "reference:string,receipt_number:string,amount:bigint,message:string,gateway_response:string,"
    "paid_at:string,created_at:string,channel:string,currency:string,ip_address:string,"
    f"metadata:string,log:{LOG},fees:bigint,fees_split:string,authorization:{AUTHORIZATION},"
    f"customer:{CUSTOMER},plan:string,split:map<string,string>,order_id:string,paidAt:string,"
    "createdAt:string,requested_amount:bigint,pos_transaction_data:string,source:string,"
    "fees_breakdown:string,connect:string,transaction_date:string,"
    "plan_object:map<string,string>,subaccount:map<string,string>>"
)
REPLY = f"status boolean, message string, data {DATA}"

TOP_FIELDS = ["status", "message", "data"]


def _data_fields() -> list[str]:
    depth, names, word = 0, [], ""
    for ch in DATA[len("struct<") : -1]:
        if depth == 0 and ch == ":":
            names.append(word)
        depth += (ch == "<") - (ch == ">")
        word = "" if depth == 0 and ch == "," else word + ch
    return names


def unknown_fields(body: Column, top: Column) -> Column:
    """Names at the top level (`top`) or inside `data` that the reply does not define."""
    inner = F.when(top.isNotNull(), F.json_object_keys(F.get_json_object(body, "$.data")))
    lit_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.concat(
        F.array_except(F.coalesce(top, F.array()), lit_array(TOP_FIELDS)),
        F.array_except(F.coalesce(inner, F.array()), lit_array(_data_fields())),
    )


def parse_gateway_payloads(raw: DataFrame, body: str = "body", max_bytes: int | None = None) -> DataFrame:
    """Adds `reply` (struct), `problem` (NULL when the reply is usable) and `body_bytes`.

    Replies of any size are parsed; `max_bytes` makes larger ones a problem.
    """
    text = F.col(body)
    blank = text.isNull() | (F.trim(text) == "")
    large = F.octet_length(text) > max_bytes if max_bytes else F.lit(False)
    keys = F.when(~(blank | large), F.json_object_keys(text))
    read = raw.withColumns({"__keys": keys, "body_bytes": F.octet_length(text)})
    read = read.withColumn("__unknown", unknown_fields(text, F.col("__keys")))
    problem = (
        F.when(blank, F.lit("body must not be empty"))
        .when(large, F.lit(f"body must not be larger than {max_bytes} bytes"))
        .when(F.col("__keys").isNull(), F.lit("body contains badly-formed JSON"))
        .when(
            F.size("__unknown") > 0,
            F.concat(F.lit("body contains unknown key "), F.col("__unknown")[0]),
        )
    )
    # The one-element array keeps filters on `problem` above the parsing: each body is
    # read three times (keys, data keys, fields), not again for every use of a result.
    checked = read.select("*", F.explode_outer(F.array(problem)).alias("problem"))
    reply = F.from_json(text, REPLY, {"mode": "PERMISSIVE"})
    return checked.drop("__keys", "__unknown").withColumn(
        "reply", F.when(F.col("problem").isNull(), reply)
    )
