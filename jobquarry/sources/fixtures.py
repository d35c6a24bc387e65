"""Texts and payloads with what is read from them; the queries over them have their results as literals."""

PAYLOADS = {
    "themuse": ({"id": 1, "name": "Dev", "company": {"name": "C"}, "locations": [{"name": "Flexible / Remote"}], "levels": [{"name": "Mid Level"}], "categories": [{"name": "IT"}], "type": "contract", "refs": {"landing_page": "u"}}, {"title": "Dev", "remote": "remote", "level": "mid", "employment_type": "contract", "department": "IT", "apply_url": "u"}),
    "breezy": ({"id": "b", "name": "Dev", "type": {"name": "Full-Time"}, "location": {"city": "Ghent", "state": {"name": "OVL"}, "country": {"name": "Belgium"}, "name": "Ghent, BE"}, "published_date": "2026-06-04T23:24:11.988Z", "description": "<p>Hi</p>"}, {"employment_type": "full_time", "remote": "unknown", "description_text": "Hi", "posted_at": "2026-06-04T23:24:11+00:00"}),
    "bamboohr": ({"id": "1", "jobOpeningName": "Dev", "employmentStatusLabel": "Part Time", "location": {"city": "Linz", "state": "OÖ"}, "isRemote": None}, {"employment_type": "part_time", "remote": "unknown"}),
    "pinpoint": ({"id": 1, "title": "Dev", "workplace_type": "hybrid", "employment_type": "contract_to_hire", "compensation_visible": True, "compensation_minimum": 10, "compensation_frequency": "hourly", "compensation_currency": "GBP"}, {"remote": "hybrid", "employment_type": "contract"}),
    "teamtailor": ({"id": "x", "title": "Remote Dev", "_jobposting": {"jobLocation": {"address": {"addressLocality": "Oslo", "addressCountry": "NO"}}, "baseSalary": {"currency": "NOK", "value": {"value": 5, "unitText": "HOUR"}}}}, {"remote": "remote"}),
    "rippling": ({"uuid": "u", "name": "Dev", "workLocation": {"label": "Bern, Switzerland"}, "department": {"label": "D"}}, {"department": "D", "remote": "unknown"}),
    "paylocity": ({"JobId": 7, "Title": "Dev", "City": "Reno", "State": "NV", "EmploymentType": "Seasonal"}, {"source_job_id": "7", "title": "Dev", "employment_type": "temporary"}),
    "applicantpro": ({"id": 3, "title": "Dev", "city": "Reno", "minSalary": "20", "maxSalary": "25.5", "payTypeFrame": "Per Hour"}, {"title": "Dev"}),
    "usajobs": ({"PositionID": "P", "OrganizationName": "Agency", "PositionTitle": "Dev", "PositionRemuneration": [{"MinimumRange": "50000.0", "MaximumRange": "60000", "RateIntervalCode": "PA"}], "PositionSchedule": [{"Name": "Intermittent"}], "PublicationStartDate": "2024-01-01T00:00:00.1234567"}, {"company": "Agency", "employment_type": "temporary", "posted_at": "2024-01-01T00:00:00+00:00"}),
    "adzuna": ({"id": "1", "title": "Dev", "company": {"display_name": "C"}, "location": {"display_name": "Leeds", "area": ["UK", "Leeds"]}, "salary_min": 10, "_country": "gb", "contract_type": "permanent"}, {"company": "C", "employment_type": "full_time"}),
    "dejobs": ({"guid": "g", "title_exact": "Dev", "location_exact": "Remote, USA", "date_added": "2024-01-01T00:00:00Z"}, {"remote": "remote", "title": "Dev"}),
    "tesla": ({"id": "9", "title": "Dev", "location": "Austin", "type": "fulltime"}, {"employment_type": "full_time", "apply_url": "https://www.tesla.com/careers/search/job/9"}),
    "ukg": ({"Id": "9", "Title": "Dev", "FullTime": True, "Locations": [{"Address": {"City": "Reno", "State": {"Code": "NV"}}}], "PostedDate": "2024-01-01T00:00:00Z"}, {"employment_type": "full_time"}),
    "adp": ({"itemID": "9", "requisitionTitle": "Dev", "workLevelCode": {"shortName": "Part-Time"}, "postDate": "2024-01-01"}, {"employment_type": "part_time", "posted_at": "2024-01-01T00:00:00+00:00"}),
    "oracle": ({"Id": "9", "Title": "Dev", "PrimaryLocation": "Remote", "WorkplaceTypeCode": "ORA_HYBRID", "PostedDate": "2024-01-01"}, {"remote": "hybrid"}),
    "phenom": ({"jobSeqNo": "9", "title": "Dev", "city": "Reno", "checkRemote": "On-Site", "type": "Co-op / Intern", "multi_category": ["IT"]}, {"remote": "onsite", "employment_type": "internship", "department": "IT"}),
    "coveo": ({"jobid": ["9"], "title": "Dev", "city": ["Pune"], "country": "India", "date": 1700000000000}, {"posted_at": "2023-11-14T22:13:20+00:00", "source_job_id": "9"}),
    "eightfold": ({"id": 9, "name": "Dev", "standardizedLocations": ["Azusa, CA, US"], "work_location_option": "on_site", "t_create": 1700000000}, {"remote": "onsite", "posted_at": "2023-11-14T22:13:20+00:00"}),
    "workable": ({"shortcode": "S", "title": "Dev", "education": "Bachelor's Degree", "experience": "Mid-Senior level", "employment_type": "Volunteer", "city": "Athens", "country": "Greece", "published_on": "2024-01-01", "description": "<p>a</p>", "requirements": "<p>b</p>"}, {"degree_min": "bachelor", "degree_required": True, "level": "senior", "employment_type": "other", "remote": "onsite", "description_text": "a b"}),
    "greenhouse": ({"id": 1, "title": "Dev", "absolute_url": "u", "location": {"name": "Remote - EU"}, "departments": [{"name": "Eng"}], "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": "2024-01-01T00:00:00Z"}, {"title": "Dev", "remote": "remote", "department": "Eng", "description_text": "Hi", "updated_at": "2024-01-01T00:00:00+00:00"}),
    "lever": ({"id": "a", "text": "Dev", "hostedUrl": "h", "workplaceType": "hybrid", "categories": {"commitment": "Full-time", "location": "Oslo", "team": "T"}, "createdAt": 1700000000000}, {"title": "Dev", "remote": "hybrid", "employment_type": "full_time", "department": "T", "apply_url": "h", "posted_at": "2023-11-14T22:13:20+00:00"}),
    "schemaorg": ({"@type": "JobPosting", "url": "u", "title": "Dev", "hiringOrganization": {"name": "Org"}, "employmentType": ["PART_TIME"], "jobLocation": {"address": {"addressLocality": "Remote", "addressCountry": "US"}}, "baseSalary": {"currency": "USD", "value": {"minValue": "50,000", "maxValue": 60000}}, "datePosted": "2024-01-01", "occupationalCategory": "IT"}, {"title": "Dev", "company": "Org", "employment_type": "part_time", "remote": "remote", "department": "IT", "source_job_id": "u"}),
    "icims": ({"id": "7", "title": "Dev", "city": "Reno", "state": "NV", "employment_type": "Full-Time", "categories": [{"name": "IT"}], "posted_date": "2024-01-01T00:00:00Z", "url": "u"}, {"title": "Dev", "employment_type": "full_time", "department": "IT", "posted_at": "2024-01-01T00:00:00+00:00", "remote": "unknown", "apply_url": "u"}),
    "workday": ({"title": "Dev", "locationsText": "Remote, US", "externalPath": "/job/1", "bulletFields": ["R-1"]}, {"title": "Dev", "source_job_id": "R-1", "remote": "remote", "posted_at": None}),
    "workable_network": ({"id": "w", "title": "Dev", "company": {"title": "C", "website": "https://www.acme.com/x"}, "workplace": "on_site", "location": {"city": "Athens", "countryName": "Greece"}, "employmentType": "Full-time", "url": "u"}, {"title": "Dev", "company": "C", "company_domain": "acme.com", "remote": "onsite", "employment_type": "full_time"}),
    "personio": ({"id": "9", "name": "Dev", "office": "Munich", "additionalOffices": ["Remote"], "employmentType": "permanent", "seniority": "experienced", "yearsOfExperience": "2-5", "department": "IT", "token": "acme", "salaryInformation": {"min": 4000, "type": "monthly", "currencyCode": "eur"}, "jobDescriptions": [{"name": "Tasks", "value": "<p>x</p>"}]}, {"title": "Dev", "remote": "remote", "employment_type": "full_time", "department": "IT", "years_experience_min": "2", "years_experience_max": "5", "apply_url": "https://acme.jobs.personio.de/job/9"}),
    "join": ({"idParam": "5-dev", "title": "Dev", "city": {"cityName": "Berlin", "countryName": "Germany"}, "workplaceType": "HYBRID", "employmentType": {"name": "Employee"}, "category": {"name": "IT"}, "createdAt": "2024-01-01T00:00:00Z", "url": "u"}, {"title": "Dev", "source_job_id": "5-dev", "remote": "hybrid", "employment_type": "full_time", "department": "IT", "posted_at": "2024-01-01T00:00:00+00:00"}),
    "taleo": ({"id": "1", "column": ["Dev", "[\"Reno\", \"Remote\"]", "Jun 17, 2026"], "linkedColumn": 0, "locationsColumns": [1]}, {"title": "Dev", "remote": "remote", "posted_at": "2026-06-17T00:00:00+00:00"}),
    "taleobe": ({"id": "1", "title": "Dev", "location": "Reno, NV", "employment_type": "Fulltime Regular", "department": "Contract Administration"}, {"title": "Dev", "employment_type": "full_time", "department": "Contract Administration", "remote": "unknown"}),
    "successfactors": ({"id": "1", "title": "Dev", "location": "Remote, DE", "url": "u"}, {"title": "Dev", "remote": "remote", "apply_url": "u"}),
    "avature": ({"id": "1", "title": "Dev", "location": "Pune", "url": "u"}, {"title": "Dev", "remote": "unknown", "apply_url": "u"}),
    "jobvite": ({"id": "1", "title": "Dev", "url": "u"}, {"title": "Dev", "remote": "unknown", "apply_url": "u"}),
    "ripplehire": ({"id": "1", "title": "Dev", "location": "Remote", "url": "u"}, {"title": "Dev", "remote": "remote", "apply_url": "u"}),
    "jazzhr": ({"id": "job_20240102030405_X", "title": "Dev", "city": "Reno", "state": "NV", "type": "Commission", "department": "Sales", "experience": "Mid Level"}, {"title": "Dev", "employment_type": "other", "department": "Sales", "level": "mid", "posted_at": "2024-01-02T03:04:05+00:00"}),
    "brassring": ({"reqid": "3", "_fields": {"JobTitle": "formtext2", "Position3": ["formtext5", "department"]}, "formtext2": "Dev", "formtext5": "Remote site", "department": "IT", "lastupdated": "05-Jan-2024"}, {"title": "Dev", "department": "IT", "remote": "remote", "updated_at": "2024-01-05T00:00:00+00:00"}),
    "apicapture": ({"a": {"t": ["Dev"]}, "loc": {"city": "Rome", "country": {"name": "Italy"}}, "kind": "Full Time", "on": "2024-01-01T09:00", "id": "4", "_spec": {"title": "a.t.0", "location": "loc", "employment_type": "kind", "posted_at": "on"}}, {"title": "Dev", "employment_type": "full_time", "posted_at": "2024-01-01T00:00:00+00:00", "remote": "unknown", "source_job_id": "4"}),
    "peopleadmin": ({"id": "2", "title": "Dev", "department": " IT ", "published": "2024-01-01T00:00:00Z", "url": "u"}, {"title": "Dev", "department": "IT", "posted_at": "2024-01-01T00:00:00+00:00"}),
    "peopleclick": ({"JPM_TITLE": "Dev", "JPM_LOCATION": "Remote", "FLD_JP_DEPARTMENT": "IT", "id": "1"}, {"title": "Dev", "department": "IT", "remote": "remote"}),
    "jobdiva": ({"id": "1", "title": "Dev", "location": "Reno", "otherLocations": ["Reno", "Remote"], "workingRemote": "Hybrid", "postDate": "2024-01-01"}, {"title": "Dev", "remote": "hybrid", "posted_at": "2024-01-01T00:00:00+00:00"}),
    "zwayam": ({"id": "1", "designation": "Dev", "locationSeparatedbySlash": "Pune", "workMode": "Remote", "jobFunction": "IT"}, {"title": "Dev", "remote": "remote", "department": "IT"}),
    "ceipal": ({"job_code": "J1", "position_title": "Dev", "city": "Reno", "remote_opportunities": "1"}, {"title": "Dev", "remote": "remote", "department": "J1"}),
    "radancy": ({"id": "1", "title": "Dev", "location": "Reno", "category": "IT"}, {"title": "Dev", "remote": "unknown", "department": "IT"}),
    "pageup": ({"id": "1", "title": "Dev", "location": "Sydney | Remote", "work_type": "Casual", "category": "IT", "pub_date": "Mon, 01 Jan 2024 00:00:00 +0000"}, {"title": "Dev", "employment_type": "temporary", "remote": "remote", "department": "IT", "posted_at": "2024-01-01T00:00:00+00:00"}),
    "peoplesoft": ({"id": "1", "title": "Dev", "location": "Reno", "department": "IT", "posted": "01/02/2024"}, {"title": "Dev", "department": "IT", "posted_at": "2024-01-02T00:00:00+00:00"}),
    "dayforce": ({"id": "1", "jobTitle": "Dev", "hasVirtualLocation": True, "postingLocations": [{"cityName": "Reno", "stateCode": "NV"}], "postingStartTimestampUTC": "2024-01-01T00:00:00Z"}, {"title": "Dev", "remote": "remote", "posted_at": "2024-01-01T00:00:00+00:00"}),
    "paycom": ({"id": "1", "jobTitle": "Dev", "locations": "HQ - Reno, NV 89501", "remoteType": "Hybrid", "positionType": "Part Time"}, {"title": "Dev", "remote": "hybrid", "employment_type": "part_time"}),
}

#: Texts with a number {n} from 1 to 30: language, text, what it states (SQL of n).
YEARS_OF_N = (
    ("en", "{n}+ years of experience", "{n}", None),
    ("en", "We ask for {n}-40 years experience in sales", "{n}", "40"),
    ("en", "up to {n} years of experience", None, "{n}"),
    ("en", "BS + 31 years OR MS + {n} years OR PhD + 32 years", "{n}", None),
    ("en", "{n} month contract", None, None),
    ("en", "in the last {n} years we grew", None, None),
    ("en", "{n} months of experience", "{n} // 12", None),
    ("de", "mindestens {n} Jahre Berufserfahrung", "{n}", None),
    ("de", "seit über {n} Jahren am Markt", None, None),
    ("de", "mehrjährige Erfahrung, Kennziffer {n}", "3", None),
    ("de", "{n} bis 35 Jahre", "{n}", "35"),
    ("fr", "au moins {n} ans dans le secteur", "{n}", None),
    ("fr", "Bac+{n} exigé, débutant accepté", "0", "2"),
    ("fr", "depuis {n} ans nous grandissons", None, None),
    ("es", "al menos {n} años", "{n}", None),
    ("es", "entre {n} y 45 años de edad", None, None),
    ("es", "empresa con más de {n} años de historia, sin experiencia previa", "0", None),
    ("es", "{n} años y medio de experiencia", "{n} + 1", None),
    (None, "no number at all", None, None),
)
#: The same for degrees: language, text, level, whether it is a must.
DEGREES_OF_N = (
    ("en", "Bachelor's degree required, {n} openings", "bachelor", True),
    ("en", "Master's degree preferred", "master", False),
    ("en", "BS required, MS preferred ({n})", "bachelor", True),
    ("en", "tuition reimbursement toward your degree", None, None),
    ("en", "{n} Scrum Master seats", None, None),
    ("en", "Ph.D. or M.D.", "phd_md", True),
    ("de", "Abgeschlossenes Studium der Informatik", "bachelor", True),
    ("de", "Ausbildung oder Studium", None, None),
    ("de", "Masterabschluss oder vergleichbare Qualifikation", "master", False),
    ("de", "Abitur, {n} Plätze", "highschool", True),
    ("fr", "Titulaire d'un Bac+5", "master", True),
    ("fr", "BTS ou équivalent", "associate", False),
    ("fr", "bonne humeur et {n} amis", None, None),
    ("es", "Grado universitario en Derecho", "bachelor", True),
    ("es", "Estudiante universitario de grado universitario", None, None),
    ("es", "Empresa de ingeniería con {n} sedes", None, None),
    (None, "", None, None),
)
#: And for pay: language, text, amounts (SQL of n), currency, interval.
PAY_OF_N = (
    ("en", "Salary: ${n}0,000 - $400,000 per year", "{n} * 10000.0", "400000.0", "USD", "year", "{n} >= 2"),
    ("en", "pay ${n}/hr", "{n}::DOUBLE", "{n}::DOUBLE", "USD", "hour", "{n} >= 7"),
    ("en", "raised $50 million in {n} rounds", None, None, None, None, "FALSE"),
    ("en", "{n},000 customers", None, None, None, None, "FALSE"),
    ("de", "Gehalt: 59.000 € brutto pro Jahr", "59000.0", "CASE WHEN FALSE THEN 1.0 END", "EUR", "year", "TRUE"),
    ("de", "zwischen 40.000 € und 60.000 € Jahresgehalt", "40000.0", "60000.0", "EUR", "year", "TRUE"),
    ("fr", "Salaire : 45 000 € - 55 000 € par an", "45000.0", "55000.0", "EUR", "year", "TRUE"),
    ("es", "Salario entre 20.000 € y 25.000 € bruto anual", "20000.0", "25000.0", "EUR", "year", "TRUE"),
    (None, "nothing here", None, None, None, None, "FALSE"),
)

YEARS = {
    "5+ years of experience": (5, None), "3-5 years experience in sales": (3, 5), "at least two years working with SQL": (2, None), "minimum of 4 years": (4, None), "up to 3 years of experience": (None, 3),
    "6-10+ years of experience": (6, None), "18 months of experience": (1, None), "6 month contract": (None, None), "must be 18 years or older": (None, None), "for over 35 years, we've built": (None, None),
    "BS + 8 years OR MS + 5 years OR PhD + 2 years": (2, None), "in the last 5 years we grew": (None, None), "7 years in marketing": (7, None), "10 yoe": (10, None), "we are 12 years in business": (None, None),
    "99 years of experience": (None, None), "30+ years of expertise, we combine": (None, None), "": (None, None), "5 years": (None, None),
}

DEGREES = {
    "Bachelor's degree required": ("bachelor", True), "Master's degree preferred": ("master", False), "BS required, MS preferred": ("bachelor", True), "Bachelor's or equivalent experience required": ("bachelor", False),
    "High school diploma or equivalent required": ("highschool", True), "Ph.D. or M.D.": ("phd_md", True), "tuition reimbursement toward your degree": (None, None), "Degree in Computer Science": ("bachelor", True),
    "high degree of autonomy": (None, None), "Scrum Master": (None, None), "Preferred Qualifications\nMBA": ("master", False), "Requirements:\nBSc in physics": ("bachelor", True),
    "Associate's or Bachelor's degree": ("associate", True), "MS Office": (None, None), "": (None, None), "Benefits\nmaster's degree": (None, None), "a 4-year computer science degree": ("bachelor", True),
}

SALARIES = {
    "Salary: $120,000 - $150,000 per year": (120000.0, 150000.0, "USD", "year"), "pay $25/hr": (25.0, 25.0, "USD", "hour"), "base salary 90k-110k": (90000.0, 110000.0, None, "year"),
    "€45.000 per annum": (45000.0, 45000.0, "EUR", "year"), "$70-130k": (70000.0, 130000.0, "USD", "year"), "up to $200k salary": (None, 200000.0, "USD", "year"), "from £30,000 a year": (30000.0, None, "GBP", "year"),
    "raised $50 million": None, "401(k) match": None, "$5,000 per employee": None, "10,000 customers": None, "40 hours per week": None, "Hourly Rate: $28.00": (28.0, 28.0, "USD", "hour"),
    "NY: $100,000 - $120,000. CA: $110,000 - $140,000": (100000.0, 140000.0, "USD", "year"), "": None, "$50/month gym": None, "earn 85,000+": (85000.0, None, None, "year"),
    "USD 4,000 monthly": (4000.0, 4000.0, "USD", "month"), "pay grew 20%": None, "call 5551234": None,
}

CITIES = {
    "Berlin": "Germany", "Boston": "United States", "New York": "United States", "London": "United Kingdom", "Toronto": "Canada", "Redmond": "United States", "Auburn": "United States", "Topeka": "United States",
    "Düsseldorf": "Germany", "Singapore": "Singapore", "Tel Aviv": "Israel", "Kuala Lumpur": "Malaysia", "Las Vegas": "United States", "Washington": "United States", "Sacramento": "United States", "Cologne": "Germany",
}
LOCATIONS = {
    "Berlin": ("Berlin", None, "Germany"), "Berlin, Germany": ("Berlin", None, "Germany"), "Sacramento, CA": ("Sacramento", "CA", "United States"), "Toronto, ON, CA": ("Toronto", None, "Canada"),
    "Toronto, ON, CA, M5V2T3": ("Toronto", None, "Canada"), "Cologne, NW, DE, 51105": ("Cologne", None, "Germany"), "London (Canada)": ("London", None, "Canada"), "Remote (US)": (None, None, "United States"),
    "Kansas-Topeka": ("Topeka", "Kansas", "United States"), "MY-14-Kuala Lumpur": ("Kuala Lumpur", None, "Malaysia"), "Boston Drydock": ("Boston", None, "United States"),
    "United States, Washington, Redmond": ("Redmond", "Washington", "United States"), "New York": ("New York", "New York", "United States"), "Auburn Hills": ("Auburn Hills", None, "United States"),
    "DUSSELDORF": ("DUSSELDORF", None, "Germany"), "3 Locations": (None, None, None), "Las Vegas-Las Vegas": ("Las Vegas", None, "United States"), "Tel Aviv-Yafo": ("Tel Aviv-Yafo", None, None),
    "Winston-Salem, NC": ("Winston-Salem", "NC", "United States"), "Warsaw, POL": ("Warsaw", None, "Poland"), "Any City": (None, None, None), "Singapore": ("Singapore", None, "Singapore"), "": (None, None, None),
}

COMPANIES = [
    ("First National Bank", "Banking/Finance"), ("Educação Global", "Education"), ("Sunrise Real Estate", "RealEstate/PropTech"), ("Embankment Ltd", None), ("Acme Renewable Energy", "Energy/Climate"),
    ("Blue Hotel Group", "Travel/Hospitality"), ("Acme", None),
    ("DOMINO'S, Inc.", "Food/Beverage"), ("Sika AG", "Manufacturing/Industrial"), ("Thales", "Aerospace/Defense"),
]
