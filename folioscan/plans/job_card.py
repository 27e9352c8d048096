"""Labels of rural-employment job cards: fixed values, in English and the scripts that cards are printed in."""

#: Field: labels as printed.
FIELDS = {
    "job_card_number": ["JOB CARD NUMBER", "JOB CARD NO", "JOB CARD", "NREGA JOB CARD NO", "MGNREGA JOB CARD NO", "REGISTRATION NUMBER", "REGISTRATION NO", "जॉब कार्ड संख्या", "जॉब कार्ड क्रमांक", "रोजगार कार्ड संख्या", "নরেগা জব কার্ড নং", "জব কার্ড নং", "ఉపాధి హామీ కార్డు సంఖ్య", "జాబ్ కార్డ్ నంబర్", "வேலை அட்டை எண்"],
    "head_of_household": ["NAME OF HEAD OF HOUSEHOLD", "HEAD OF HOUSEHOLD", "HOUSEHOLD HEAD NAME", "NAME OF APPLICANT", "APPLICANT NAME", "परिवार के मुखिया का नाम", "मुखिया का नाम", "परिवार प्रमुख का नाम", "পরিবারের প্রধানের নাম", "కుటుంబ యజమాని పేరు", "குடும்பத் தலைவர் பெயர்"],
    "category": ["CATEGORY", "SOCIAL CATEGORY", "CASTE CATEGORY", "वर्ग", "श्रेणी", "সামাজিক শ্রেণী", "వర్గం", "வகை"],
    "registration_date": ["DATE OF REGISTRATION", "REGISTRATION DATE", "DATE OF ISSUE", "ISSUE DATE", "पंजीकरण की तारीख", "पंजीकरण दिनांक", "जारी करने की तारीख", "নিবন্ধনের তারিখ", "నమోదు తేదీ", "பதிவு தேதி"],
    "validity": ["VALIDITY PERIOD", "VALIDITY", "वैधता अवधि", "বৈধতার সময়কাল", "చెల్లుబాటు కాలం", "செல்லுபடியாகும் காலம்"],
    "address": ["HOUSEHOLD ADDRESS", "ADDRESS", "पता", "घर का पता", "ঠিকানা", "చిరునామా", "முகவரி"],
    "village": ["NAME OF VILLAGE", "VILLAGE NAME", "VILLAGE", "गांव का नाम", "गाँव", "ग्राम", "গ্রাম", "గ్రామం", "கிராமம்"],
    "gram_panchayat": ["NAME OF GRAM PANCHAYAT", "GRAM PANCHAYAT", "G P NAME", "PANCHAYAT", "ग्राम पंचायत का नाम", "ग्राम पंचायत", "পঞ্চায়েত", "গ্রাম পঞ্চায়েত", "గ్రామ పంచాయతీ", "ஊராட்சி"],
    "block": ["NAME OF BLOCK", "DEVELOPMENT BLOCK", "BLOCK", "MANDAL", "विकास खंड", "विकासखण्ड", "ब्लॉक", "खंड", "ব্লক", "మండలం", "ஒன்றியம்", "வட்டாரம்"],
    "district": ["DISTRICT NAME", "DISTRICT", "जिला", "जनपद", "জেলা", "జిల్లా", "மாவட்டம்"],
    "state": ["STATE NAME", "STATE", "राज्य", "প্রদেশ", "রাজ্য", "రాష్ట్రం", "மாநிலம்"],
    "bpl_status": ["WHETHER BPL", "BPL STATUS", "BPL FAMILY", "BELOW POVERTY LINE", "क्या बीपीएल", "बीपीएल परिवार", "দারিদ্র্য সীমার নিচে", "బిపిఎల్ కుటుంబం", "வறுமைக் கோட்டிற்கு கீழ்"],
    "family_id": ["FAMILY ID", "FAMILY IDENTIFICATION NUMBER", "HOUSEHOLD ID", "परिवार आईडी", "परिवार पहचान संख्या", "পারিবারিক আইডি", "కుటుంబ ఐడి", "குடும்ப அடையாள எண்"],
    "members": ["DETAILS OF THE APPLICANTS OF THE HOUSEHOLD WILLING TO WORK", "DETAILS OF APPLICANTS", "HOUSEHOLD MEMBERS WILLING TO WORK", "ADULT MEMBERS WILLING TO WORK", "काम करने के इच्छुक परिवार के सदस्यों का विवरण", "आवेदकों का विवरण", "কাজ করতে ইচ্ছুক সদস্যদের বিবরণ", "పని చేయడానికి సిద్ధంగా ఉన్న సభ్యుల వివరాలు", "வேலை செய்ய விரும்பும் உறுப்பினர்கள் விவரம்"],
}
#: Labels that are too short to tell a known label from a value.
ENDS = {"valid_from": ["VALID FROM", "FROM", "से", "হইতে", "నుండి", "முதல்"], "valid_to": ["VALID TO", "TO", "तक", "পর্যন্ত", "వరకు", "வரை"]}
#: Headers of the member table by kind.
HEADERS = {
    "serial": ["SL NO", "SERIAL NO", "S NO", "क्रम संख्या", "क्र सं", "ক্রমিক নং", "క్రమ సంఖ్య", "வ எண்"],
    "relation": ["FATHER HUSBAND NAME", "FATHERS HUSBANDS NAME", "FATHER S HUSBAND S NAME", "FATHER OR HUSBAND NAME", "PARENT SPOUSE NAME", "पिता पति का नाम", "पिता या पति का नाम", "পিতা স্বামীর নাম", "తండ్రి భర్త పేరు", "தந்தை கணவர் பெயர்"],
    "gender": ["MALE FEMALE", "GENDER", "SEX", "लिंग", "पुरुष महिला", "লিঙ্গ", "స్త్రీ పురుష", "లింగం", "பாலினம்"],
    "age": ["AGE ON DATE OF REGISTRATION", "AGE AT REGISTRATION", "AGE", "पंजीकरण के समय आयु", "उम्र", "आयु", "বয়স", "వయస్సు", "வயது"],
    "name": ["MEMBER NAME", "NAME OF MEMBER", "NAME OF APPLICANT", "NAME", "सदस्य का नाम", "आवेदक का नाम", "नाम", "সদস্যের নাম", "নাম", "సభ్యుని పేరు", "పేరు", "உறுப்பினர் பெயர்", "பெயர்"],
}
