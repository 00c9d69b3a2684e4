"""Interchange schemas (Spark DDL)."""

RISK = (
    "struct<id:string,title:string,severity:string,icon:string,description:string,"
    "types:array<array<string>>,impacts:array<string>,mitigations:array<string>,"
    "examples:array<string>,references:array<string>>"
)
_LEAF_SECTION = (
    "title:string,content:string,code_examples:array<string>,"
    "warnings:array<string>,tips:array<string>"
)
SECTION = f"struct<{_LEAF_SECTION},subsections:array<struct<{_LEAF_SECTION}>>>"
ATTACK_EXAMPLE = (
    "struct<risk_id:string,title:string,goal:string,attack_prompt:string,"
    "impact:string,mitigation:string>"
)
SHEET = (
    "id string, title string, url string, description string, category string, icon string, "
    f"introduction string, sections array<{SECTION}>, risks array<{RISK}>, "
    f"attack_examples array<{ATTACK_EXAMPLE}>, last_updated string, "
    "contributors array<string>, related_cheatsheets array<string>, tags array<string>, "
    "raw_markdown string"
)
NUMBERED_RISKS = f"id string, title string, source_url string, risks map<string,{RISK}>"
CODE_QUALITY = "critical_issues array<string>, minor_issues array<string>, reasoning string"

def security_review(category_list: str = "categories") -> str:
    """Schema of a security review; ``category_list`` is the field that holds the coverage list."""
    return (
        "security_vulnerabilities array<struct<description:string,risk_level:string,evidence:string>>, "
        f"`{category_list}` array<struct<id:string,name:string,status:string,evidence:string>>, "
        "blocking boolean, highest_risk string, security_recommendations array<string>"
    )


FIX = "struct<description:string,solutions:string,explanation:string>"
SUMMARY = f"confidence int, findings string, fix array<{FIX}>, recommendations string"
REVIEW_STATE = (
    "id string, pr_file_path string, pr_content string, errors array<string>, "
    "review_result string, crew_needed boolean, "
    "tokens_used struct<total_tokens:bigint,prompt_tokens:bigint,cached_prompt_tokens:bigint,"
    "completion_tokens:bigint,successful_requests:bigint>, final_answer string"
)
SNAPSHOT = (
    "identifier string, key string, payload string, created_at timestamp, "
    "expires_at timestamp, content_hash string, size_bytes bigint"
)
