"""Schemas of stored tables. A `job` is one site crawl; `ord` is a page's place in it."""

PRODUCT = "struct<name:string,description:string,price:string,currency:string,sku:string,brand:string,category:string,images:array<string>>"
SIGNALS = f"struct<ogType:string,jsonLdTypes:array<string>,product:{PRODUCT},hasPrice:boolean,hasCartButton:boolean>"
FIELD = "struct<tag:string,type:string,name:string,label:string,placeholder:string,required:boolean>"
FORM = f"struct<action:string,method:string,fields:array<{FIELD}>,submitLabel:string>"
STRUCTURE = f"struct<headings:array<struct<level:int,text:string>>,forms:array<{FORM}>,nav:array<struct<text:string,href:string>>,footerText:string,signals:{SIGNALS}>"
#: One scraped page of a job.
PAGE = f"job_id string, ord long, slug string, url string, status string, kind string, raw string, title string, description string, structure {STRUCTURE}"
MAPPING = "struct<status:string,startedAt:string,finishedAt:string,discovered:long,error:string,activity:struct<phase:string,lastUrl:string,fetchErrors:long,lastError:struct<url:string,message:string,at:string>,updatedAt:string>>"
PAGE_ENTRY = "struct<url:string,status:string,kind:string,contentHash:string,scrapedAt:string,error:string>"
JOB = f"source string, sourceKey string, createdAt string, updatedAt string, mapping {MAPPING}, pages map<string,{PAGE_ENTRY}>"
FACT = "kind string, value string, unit string, label string, context string, confidence double, needsReview boolean"
PAGE_STATUSES = ["pending", "scraping", "done", "skipped", "failed"]
MAPPING_STATUSES = ["mapping", "mapped", "cancelled", "failed"]
PHASES = ["sitemap", "crawl"]
