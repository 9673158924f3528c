"""Declared schemas: nothing is inferred; unknown fields are dropped, missing ones are null."""

SEGMENT = (
    "sid string, doc_id string, sec_path string, sec_heading string, sec_level int, index int, page int, src_text string, n_words int, "
    "indented boolean, col int, in_box boolean, is_figure boolean, fig_label string"
)
SECTION = f"heading string, level int, page int, segments array<struct<{SEGMENT.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>"
DOCUMENT = f"doc_id string, title string, pdf_path string, sections array<struct<heading:string,level:int,page:int,segments:array<struct<{SEGMENT.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(', ', ',')}>>>>"
RECORD = "index:int,sec_path:string,sec_heading:string,page:int,n_words:int,src:string,zh:string,zh_raw:string,cached:boolean,hits:array<string>"
TRANSLATION = f"doc_id string, title string, provider string, model string, prompt_version string, segments map<string,struct<{RECORD}>>"
SCRIPT = "doc_id string, title string, model string, style string, segments map<string,struct<index:int,sec_path:string,sec_heading:string,page:int,script:string,preserve_ratio:double>>"
TIMELINE = "doc_id string, total_duration_sec double, segments array<struct<sid:string,sec_path:string,sec_heading:string,page:int,script:string,norm_script:string,start_sec:double,end_sec:double,duration_sec:double,sentences:array<struct<text:string,start_sec:double,end_sec:double>>>>"
CACHE = "key string, value string, meta map<string,string>"
SNAPSHOT = "date string, snapshot string, generated_at string, term string, days int, model string, prompt_version string, count int, items array<struct<n:int,pmid:string,doi:string,doc_id:string,journal:string,journal_abbr:string,title_en:string,title_zh:string,brief:string,detail:string,abstract:string,pub_date:string,entrez_date:string,term_field:string,status:string,url_doi:string,url_pubmed:string,run_command:string>>"
DOC_META = "doc_id string, field string"
LIBRARY = "doc_id string, title string, createdAt string, html string, durationSec double, segCount int, hasAudio boolean"
ARTICLE = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "Journal:struct<Title:string,ISOAbbreviation:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,"
    "PublicationTypeList:struct<PublicationType:array<string>>>>, "
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>,History:struct<PubMedPubDate:array<struct<_PubStatus:string,Year:string,Month:string,Day:string>>>>"
)
# Where each stage leaves its artefacts.
ARTIFACTS = {"segments": "segments/{}.json", "translation": "translation/{}.json", "script": "script/{}.json", "timeline": "audio/{}.json", "reader": "reader/{}.html"}
