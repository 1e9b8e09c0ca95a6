"""Texts and what the engine reads in them: one table of examples for each function, for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import hints, pay, places, quality, text, urls, work

#: name: (function, [(input, result)]).  Results follow the stated behaviour, not a run of this code.
EXAMPLES = {
    "location_display": (places.location_display, [
        ("NEW YORK, NY", "New York, NY"), ("CITY OF INDUSTRY, CA", "City of Industry, CA"), ("MCKINNEY, TX", "McKinney, TX"), ("O'FALLON, IL", "O'Fallon, IL"), ("London, UK", "London, UK"), ("  SAN   JOSE ", "San Jose"), ("REMOTE / US", "Remote / US"), ("", ""), (None, ""),
    ]),
    "clean_location": (places.clean_location, [
        ("Location: New York, NY", "New York, NY"), ("NY - Brooklyn - Office 12, United States", "Brooklyn, NY"), ("Boston, Massachusetts, United States", "Boston, MA"), ("Remote - United States", "United States"), ("Remote, TX", "Texas"), ("Remote within team", "Remote"),
        ("United States", "United States"), ("Seoul, Korea, Republic of", "Seoul, South Korea"), ("London, England, United Kingdom", "London, England, United Kingdom"), ("Gibraltar", "Gibraltar"), ("Canada, Mexico", "Canada, Mexico"), ("Austin TX 78701", "Austin, TX"), ("Manhattan, New York City", "New York City, NY"),
        ("AUSTIN, TX (Hybrid)", "Austin, TX"), ("based in Denver, CO", "Denver, CO"), ("Full Time | Posted", ""), ("Chicago, IL - Remote", "Chicago, IL"), ("", ""), (None, ""),
    ]),
    "state_abbreviation": (places.state_abbrev, [("new york", "NY"), ("Washington State", "WA"), ("tx", "TX"), ("Ontario", ""), (None, "")]),
    "broad_location": (lambda c: places.is_broad(c).cast("string"), [("Remote", "true"), ("United States, US", "true"), ("usa, ny", "true"), ("Boston, MA", "false"), ("", "true")]),
    "internal_location": (lambda c: places.looks_internal(c).cast("string"), [("US12-Main", "true"), ("locations 4", "true"), ("Boston, MA", "false")]),
    "locations_in_text": (places.locations_in, [("Offices in Boston, MA and Austin, TX and Denver, CO.", "Boston, MA, Austin, TX"), ("nothing here", ""), (None, "")]),
    "listed_locations": (places.listed_locations, [("USA, WA, Seattle USA, NY, New York Job details", "Seattle, WA; New York, NY"), ("none", "")]),
    "link_location": (places.from_link, [
        ("https://x.com/jobs/analyst-queens", "Queens, NY"), ("https://x.com/job/analyst-new-york-ny", "New York, NY"), ("https://x.com/jobs/analyst-austin-texas-united-states", "Austin, TX"), ("https://x.com/jobs/analyst-remote-ohio", "Ohio"), ("https://x.com/jobs/analyst-remote-usa", "United States"), ("https://x.com/staten-island/job", "Staten Island, NY"), ("https://x.com/careers/123", ""),
    ]),
    "taleo_location": (places.taleo_location, [("Primary Location: United States-New York-Buffalo", "Buffalo, NY"), ("no label", "")]),
    "workday_location": (places.workday_location, [("Primary Location: BUFFALO New York United States Time Type: Full", "Buffalo, NY"), ("Primary Location: Boston, MA Salary Range: 1", "Boston, MA"), ("none", "")]),
    "salary_display": (pay.salary_display, [
        ("Salary range: $70,000 - $85,000 per year", "$70,000 - $85,000 per year"), ("$20 - $20 per hour", "$20 per hour"), ("20-20", "20"), ("Base pay is competitive", ""), ("$20/hour - $20/year", "$20/hour - $20/year"), ("$20–$25/hour", "$20 - $25/hour"), ("USD 50,000 to $50,000 per year", "USD 50,000 per year"), ("CAD 50k - USD 50k", "CAD 50k - USD 50k"),
        ("£30,000 - GBP 30,000", "£30,000"), ("Pay: $18/hr", "$18/hr"), ("n/a", "n/a"), ("", ""), (None, ""),
    ]),
    "text_salary": (pay.extract_salary, [
        ("We pay $70,000 - $85,000 per year plus", "$70,000 - $85,000 per year"), ("hourly rate: $20 - $24 for all", "$20 - $24 per hour"), ("earn $45 per hour", "$45 per hour"), ("$120,000 annually", "$120,000 annually"), ("from 80k - 95k", "80k - 95k"), ("nothing", ""), (None, ""),
    ]),
    "context_salary": (pay.contextual_salary, [
        ("Base salary: $90,000 - $95,000. Other $10", "$90,000 - $95,000"), ("We manage $500,000 in assets. " + "x" * 200 + " The pay range is $50,000 - $60,000 per year", "$50,000 - $60,000 per year"), ("A budget of $5,000", ""), ("pay $15 " + "y" * 300 + " salary $40 - $50 per hour", "$40 - $50 per hour"), ("", ""),
    ]),
    "plain_salary": (lambda c: pay.labelled_range(c, F.lit("Boston, MA")), [("Salary range for this role is 50,000 - 60,000", "$50,000 - $60,000"), ("Salary range: negotiable", "")]),
    "header_salary": (pay.header_salary, [("$80,000 – $90,000 Remote About the job we pay $1", "$80,000 - $90,000"), ("About the job $80,000 - $90,000", "")]),
    "more_complete_salary": (lambda c: pay.more_complete(c, F.lit("$20 - $25")).cast("string"), [("$20 - $25 per hour", "true"), ("$20 - $25", "false"), ("$30 per hour", "false"), ("", "false")]),
    "normal_work_type": (work.normalize_work_type, [("hybrid remote", "Hybrid"), ("TELECOMMUTE", "Remote"), ("in_office", "Onsite"), ("In person", "Onsite"), ("full time", ""), (None, "")]),
    "text_work_type": (work.extract_work_type, [("a hybrid role on-site", "Hybrid"), ("remote or on-site", ""), ("fully remote team", "Remote"), ("you may be eligible for remote work", ""), ("may be eligible for telework. This role is remote", "Remote"), ("office-based", "Onsite"), ("", "")]),
    "labelled_work_type": (work.labelled, [("Workplace type: Hybrid", "Hybrid"), ("Location: Remote", "Remote"), ("an on-site position", "Onsite"), ("none", "")]),
    "stated_work_type": (work.statement, [("This role is hybrid.", "Hybrid"), ("this is an in-office job", "Onsite"), ("the team is remote", "")]),
    "record_work_type": (work.location_type, [("TELECOMMUTE", "Remote"), ("fully remote", "Remote"), ("In-Person", "Onsite"), ("other", "")]),
    "captured_work_type": (work.captured_work_type, [("Worldwide", "Remote"), ("on site", "Onsite"), ("Part time", "")]),
    "work_type_conflict": (lambda c: work.conflict(c).cast("string"), [("remote and on-site", "true"), ("hybrid: remote and on-site", "false"), ("remote", "false")]),
    "clean_company": (text.clean_company, [
        ("Company: Acme Corp", "Acme Corp"), ("Acme 4.2 out of 5 stars", "Acme"), ("©2024 Acme, all rights reserved", "Acme"), ("Acme Careers", "Acme"), ("LE001 Acme Holdings", "Acme Holdings"), ("twosigma", "Two Sigma"), ("MS Smith Barney LLC", "Morgan Stanley"), ("n/a", ""), ("©", ""), ("A&amp;B", "A&B"), (None, ""),
    ]),
    "clean_title": (lambda c: text.clean_title(c, F.lit("Acme")), [
        ("Data Analyst | LinkedIn", "Data Analyst"), ("Acme - Data Analyst", "Data Analyst"), ("Data Analyst - Acme Inc", "Data Analyst"), ("Data Analyst (Remote)", "Data Analyst"), ("Data Analyst - Fully Remote, US", "Data Analyst"), ("Ai Engineer in Remote", "AI Engineer"), ("Job Title: Qa Lead", "QA Lead"), ("Analyst clone", "Analyst"), (None, ""),
    ]),
    "page_title_company": (text.company_from_page_title, [("Job Application for Analyst at Acme | Board", "Acme"), ("Analyst at Acme | Jobs", "Acme"), ("Analyst", "")]),
    "page_title_job": (text.job_from_page_title, [("Data Analyst | Acme Careers", "Data Analyst"), ("Data Analyst Job Details | Acme", "Data Analyst"), ("Welcome", "")]),
    "slug_title": (text.slug_title, [("data-analyst-12345", "Data Analyst"), ("senior_ai+engineer--0123456789abcdef", "Senior AI Engineer"), ("qa-lead~0a1b", "QA Lead"), ("job-apply", ""), (None, "")]),
    "slug_name": (text.slug_name, [("acme-labs", "Acme Labs"), ("jetblue", "JetBlue"), ("acmecareers", "Acme"), ("big_co-inc", "Big Co")]),
    "link_company": (hints.company_from_link, [
        ("https://boards.greenhouse.io/acme/jobs/1", "Acme"), ("https://job-boards.greenhouse.io/embed?for=big-co", "Big Co"), ("https://jobs.lever.co/acme-labs/1", "Acme Labs"), ("https://jobs.ashbyhq.com/rho/1", "Rho"), ("https://acme.wd1.myworkdayjobs.com/x/job/1", "Acme"), ("https://careers.acme.com/jobs/1", "Acme"), ("https://www.linkedin.com/jobs/view/1", ""), ("https://acme.com/jobs", "Acme"),
    ]),
    "link_title": (lambda c: hints.link_hints(c)["job_title"], [
        ("https://www.linkedin.com/jobs/view/data-analyst-at-acme-1234567", "Data Analyst"), ("https://www.upwork.com/freelance-jobs/apply/data-work_~012ab/", "Data Work"), ("https://wellfound.com/jobs/123-data-analyst", "Data Analyst"), ("https://www.monster.com/job-openings/data-analyst-boston-ma--0123456789abcdef", "Data Analyst"), ("https://www.naukri.com/job-listings-data-analyst-acme-pune-1-to-3-years-1", "Data Analyst"), ("https://acme.com/jobs/1", ""),
    ]),
    "link_place": (lambda c: hints.link_hints(c)["location"], [("https://www.monster.com/job-openings/data-analyst-boston-ma--0123456789abcdef", "Boston, MA"), ("https://www.naukri.com/job-listings-data-analyst-acme-pune-1-to-3-years-1", "Pune, India"), ("https://acme.com/jobs/1", "")]),
    "own_company": (hints.own_company, [("https://careers.twosigma.com/x", "Two Sigma"), ("https://a.paramount.com/", "Paramount"), ("https://my-paramount.com.greenhouse.io/", ""), (None, "")]),
    "linkedin_id": (hints.linkedin_id, [("https://www.linkedin.com/jobs/view/analyst-1234567/", "1234567"), ("https://www.linkedin.com/jobs/view/99", ""), ("https://x.com/jobs/view/1234567", "")]),
    "posting_link": (lambda c: hints.is_posting_link(c).cast("string"), [
        ("https://www.linkedin.com/jobs/view/1", "true"), ("https://www.monster.com/job/1", "false"), ("https://acme.com/careers/", "false"), ("https://acme.com/careers/12", "true"), ("https://acme.com/jobsearch?x", "false"), ("https://boards.greenhouse.io/acme/jobs/1", "true"), ("https://jobs.lever.co/acme", "false"), ("https://wellfound.com/jobs/12-x", "true"), ("https://acme.com/about", "false"),
    ]),
    "search_page": (lambda c: urls.is_search_page(c).cast("string"), [("https://www.linkedin.com/jobs/search/?k=1", "true"), ("https://www.indeed.com/q-analyst-jobs.html", "true"), ("https://www.monster.com/jobs/search", "true"), ("https://www.ziprecruiter.com/jobs-search", "true"), ("https://www.linkedin.com/jobs/view/1", "false"), ("https://acme.com/jobs", "false")]),
    "workday_endpoint": (hints.workday_endpoint, [("https://acme.wd1.myworkdayjobs.com/en-US/careers/job/Boston/Analyst_R1", "https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/careers/job/Analyst_R1"), ("https://acme.com/job/1", "")]),
    "alternate_link": (hints.alternate_link, [("https://app.digitalhire.com/job-detail/77", "https://jobs.digitalhire.com/job-listing/opening/77"), ("https://acme.com/", "")]),
    "pasted_link": (urls.clean_url, [("see https://a.com/x?b=1&amp;c=2).", "https://a.com/x?b=1&c=2"), ("​https://a.com/x;", "https://a.com/x"), ("https://a.com/1https://b.com/2", "https://a.com/1"), ("no link", "no link"), (None, "")]),
    "link_identity": (urls.url_key, [
        ("HTTPS://WWW.Acme.com./Jobs/1/?utm_source=x&b=2&a=1#top", "acme.com/Jobs/1?a=1&b=2"), ("https://www.linkedin.com/jobs/view/analyst-at-acme-1234567?trk=x", "linkedin.com/jobs/view/1234567"), ("https://www.indeed.com/viewjob?from=x&jk=AbC", "indeed.com/viewjob?jk=abc"), ("http://acme.com:80/", "acme.com/"), ("http://acme.com:8080/x;v=1", "acme.com:8080/x"),
    ]),
    "link_problem": (lambda c: F.coalesce(urls.url_problem(c), F.lit("")), [
        ("https://acme.com/1", ""), ("https://[::1]/", "Local and private network links are not allowed."), ("https://[fe80::1]/", "Local and private network links are not allowed."), ("https://[2606:4700::1111]/", ""), ("https://acme.com:99999/", "Add a complete job link."), ("http://10.0.0.7/", "Local and private network links are not allowed."), ("http://8.8.8.8/", ""),
        ("https://a.internal/", "Local and private network links are not allowed."), ("ftp://acme.com/", "The link must start with http:// or https://."), ("https://me:pw@acme.com/", "Links containing usernames or passwords are not supported."), ("https://acme.com/" + "x" * 4100, "The job link is too long."),
    ]),
    "tracker_key": (urls.link_key, [(" https://Acme.com/Jobs/1// ", "https://acme.com/jobs/1"), ("https://acme.com/?b=2&a=1", "https://acme.com/?b=2&a=1"), (None, "")]),
    "source_name": (urls.source_label, [("  google   JOBS ", "Google Jobs"), ("auto", ""), ("null", "N/A"), ("My board", "My board"), ("linkedin", "LinkedIn"), (None, "")]),
    "page_status": (quality.page_error, [("Job Not Found", "This job posting is no longer available."), ("Just a moment...", "Website blocked automated access to this posting."), ("Data Analyst", ""), (None, "")]),
    "friendly_error": (quality.friendly_error, [("HTTP 404", "This posting is unavailable or has expired."), ("Request timed out", "The website took too long to respond. Try this job again."), ("captcha shown", "The website blocked automated access. Open the job page yourself, then use browser capture."), ("odd", "This posting could not be read. Try again or check the link yourself."), ("", "")]),
    "good_title": (lambda c: quality.acceptable("job_title", c).cast("string"), [("Data Analyst", "true"), ("Analyst jobs", "false"), ("Apply now", "false"), ("acme.com", "false"), ("x" * 141, "false"), ("", "false")]),
    "good_company": (lambda c: quality.acceptable("company", c).cast("string"), [("Acme", "true"), ("Careers", "false"), ("Benefit programs of Acme", "false"), ("", "false")]),
    "good_salary": (lambda c: quality.acceptable("salary", c).cast("string"), [("$5", "true"), ("80k - 90k", "true"), ("good", "false")]),
    "generic_employer": (lambda c: quality.generic_employer(c).cast("string"), [("Monster", "true"), ("", "true"), ("Acme", "false")]),
    "label_field": (text.field_of_label, [("Pay range", "salary"), ("Workplace", "work_type"), ("Employment type", "work_type"), ("Office", "location"), ("Client", "company"), ("Position title", "job_title"), ("Other", "")]),
    "capture_title": (lambda c: text.split_capture_title(c)["company"], [("Data Analyst at Acme", "Acme"), ("Data Analyst - Acme | Board", "Acme"), ("Data Analyst - Boston, MA", ""), ("Data Analyst", "")]),
}


def evaluated(rows, name: str, column: str):
    """rows, and the result of the named function on a column."""
    return rows.withColumn("result", EXAMPLES[name][0](F.col(column)))
