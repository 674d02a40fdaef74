"""Known answers: a small catalog, requests, what they are routed to and what is left."""

# Fixed values. Names, then family, six chemistry values, hardness
# bounds and five ratings in the column order of the record.
CATALOG = [
    ("ASP 2023", "Cutting tools", 1.28, 4.0, 5.0, 6.4, 3.1, 0.0, 64.0, 66.0, 6.0, 7.0, 7.5, 6.5, 6.0),
    ("ASP 2030", "Cutting tools", 1.28, 4.2, 5.0, 6.4, 3.1, 8.5, 65.0, 67.0, 5.5, 8.0, 6.0, 8.5, 5.5),
    ("ASP 2011", "Cutting tools", 2.48, 5.3, 1.2, 0.0, 9.5, 0.0, 60.0, 62.0, 4.0, 9.5, 5.5, 5.0, 4.0),
    ("BlueTap Max", "Cutting tools", 0.93, 4.2, 5.0, 6.3, 1.8, 4.8, 64.0, 66.0, 7.0, 7.5, 7.0, 7.5, 8.0),
    ("Evoloop M42", "Cutting tools", 1.08, 3.8, 9.4, 1.5, 1.2, 8.0, 66.0, 68.0, 6.5, 7.0, 5.0, 8.5, 6.0),
    ("ASP 2012", "Cold work", 0.6, 4.0, 2.0, 2.1, 1.5, 0.0, 58.0, 61.0, 7.5, 5.5, 9.5, 5.0, 8.0),
    ("ASP 2042", "Cold work", 1.08, 3.8, 9.4, 1.6, 1.2, 8.0, 65.0, 67.0, 6.0, 7.5, 6.5, 8.5, 6.5),
    ("ASP 2048", "Cold work", 1.5, 3.8, 5.3, 9.8, 3.1, 8.5, 66.0, 68.0, 4.5, 8.5, 5.5, 9.0, 5.0),
    ("ASP 2078", "Cold work", 2.3, 4.2, 7.0, 6.5, 6.5, 10.5, 67.0, 69.0, 6.5, 9.0, 5.0, 9.5, 5.5),
    ("ASP 2060", "Cutting tools", 2.3, 4.2, 7.0, 6.5, 6.5, 10.5, 67.0, 69.0, 4.0, 9.5, 5.0, 9.5, 4.5),
    ("ASP 2053", "Specialties", 2.48, 4.2, 3.1, 4.2, 8.0, 0.0, 64.0, 66.0, 4.5, 9.0, 6.0, 6.5, 4.5),
    ("ASP APZ10", "Specialties", 1.25, 19.0, 2.1, 0.0, 0.8, 0.0, 58.0, 60.0, 6.0, 7.0, 7.0, 4.0, 7.0),
    ("ASP 2190", "Specialties", 0.78, 4.2, 2.9, 2.9, 1.1, 29.0, 68.0, 70.0, 3.5, 9.0, 4.5, 10.0, 4.0),
]

CO0, CO8, CO75 = "co_pct = 0", "co_pct > 8.0", "co_pct >= 7.5"
AROUND = "hardness_min <= 62 AND hardness_max >= 58"
COLD = "family = 'Cold work'"

# Request, conditions in order, search text, survivors, rules of the case.
REQUESTS = {
    "01": (
        "Cold work tooling, max toughness, HRC around 60, zero cobalt.",
        [CO0, AROUND, COLD],
        "cold work tooling max toughness hrc zero cobalt",
        "ASP 2012",
        '{"co_pct": ["==", 0.0], "hardness_max": [">=", 60.0]}',
    ),
    "02": (
        "High wear resistance drill grade, >8% Cobalt",
        [CO8],
        "high wear resistance drill cobalt",
        "ASP 2030, ASP 2048, ASP 2078, ASP 2060, ASP 2190",
        '{"co_pct": [">", 8.0]}',
    ),
    "03": (
        "Dedicated steel for manufacturing machine taps, balanced grindability and toughness.",
        [],
        "dedicated steel manufacturing machine taps balanced grindability toughness",
        ", ".join(r[0] for r in CATALOG),
        '{"hardness_max": [">=", 64.0]}',
    ),
    "04": (
        "Extreme wear resistance industrial granulator knives, non-cobalt, high vanadium (>5% vanadium).",
        [CO0, "v_pct >= 5.0"],
        "extreme wear resistance industrial granulator knives non-cobalt high vanadium vanadium",
        "ASP 2011, ASP 2053",
        '{"co_pct": ["==", 0.0], "v_pct": [">=", 5.0]}',
    ),
    "05": (
        "Plastic injection molds in corrosive environment, stainless high chromium PM tool steel.",
        ["cr_pct >= 12.0"],
        "plastic injection molds corrosive environment stainless high chromium pm tool steel",
        "ASP APZ10",
        '{"cr_pct": [">=", 15.0]}',
    ),
    "06": (
        "Dry high-speed gear skiving requiring extreme hot hardness and ultra-high cobalt (>20% cobalt).",
        ["co_pct >= 20.0"],
        "dry high-speed gear skiving requiring extreme hot hardness ultra-high cobalt cobalt",
        "ASP 2190",
        '{"co_pct": [">=", 20.0], "hardness_max": [">=", 68.0]}',
    ),
    "07": (
        "Heavy blanking punches and stamping dies requiring max toughness and shock resistance, zero cobalt.",
        [CO0],
        "heavy blanking punches stamping dies requiring max toughness shock resistance zero cobalt",
        "ASP 2023, ASP 2011, ASP 2012, ASP 2053, ASP APZ10",
        '{"co_pct": ["==", 0.0], "hardness_max": [">=", 60.0]}',
    ),
    "08": (
        "General purpose cutting tools and cold work, balanced wear and toughness, cobalt-free, at least 64 HRC.",
        [CO0, "hardness_max >= 64.0"],
        "general purpose cutting tools cold work balanced wear toughness cobalt-free hrc",
        "ASP 2023, ASP 2053",
        '{"co_pct": ["==", 0.0], "hardness_max": [">=", 64.0]}',
    ),
    "09": (
        "High-sulfur powder metallurgy grade with improved machinability for complex cold work tooling, at least 67 HRC.",
        ["hardness_max >= 67.0", COLD, "machinability >= 6.0"],
        "high-sulfur powder metallurgy improved machinability complex cold work tooling hrc",
        "ASP 2042, ASP 2078",
        '{"hardness_max": [">=", 67.0]}',
    ),
    "10": (
        "Conventional HSS for bi-metal bandsaw teeth with 8% cobalt, at least 66 HRC.",
        [CO75, "hardness_max >= 66.0"],
        "conventional hss bi-metal bandsaw teeth cobalt hrc",
        "ASP 2030, Evoloop M42, ASP 2042, ASP 2048, ASP 2078, ASP 2060, ASP 2190",
        '{"co_pct": [">=", 7.5], "hardness_max": [">=", 66.0]}',
    ),
    "11": (
        "High wear cold forming punches for glass-fiber filled plastics, high vanadium (>5% vanadium), zero cobalt.",
        [CO0, "v_pct >= 5.0"],
        "high wear cold forming punches glass-fiber filled plastics high vanadium vanadium zero cobalt",
        "ASP 2011, ASP 2053",
        '{"co_pct": ["==", 0.0], "v_pct": [">=", 5.0]}',
    ),
    "12": (
        "Heavy-duty gear hobbing broaches requiring high cobalt (>8% cobalt) and high tungsten, peak hardness at least 67 HRC.",
        [CO8, "hardness_max >= 67.0"],
        "heavy-duty gear hobbing broaches requiring high cobalt cobalt high tungsten peak hardness hrc",
        "ASP 2030, ASP 2048, ASP 2078, ASP 2060, ASP 2190",
        '{"co_pct": [">=", 8.0], "hardness_max": [">=", 67.0]}',
    ),
    "13": (
        "Maximum hot hardness and extreme wear resistance for cutting tools, 10% cobalt and 6% vanadium.",
        ["co_pct >= 10.0", "v_pct >= 6.0"],
        "maximum hot hardness extreme wear resistance cutting tools cobalt vanadium",
        "ASP 2078, ASP 2060",
        '{"co_pct": [">=", 10.0], "v_pct": [">=", 6.0]}',
    ),
    "14": (
        "Cold work stamping punches for high strength sheet metal, at least 8% cobalt and at least 67 HRC.",
        [CO75, "hardness_max >= 67.0", COLD],
        "cold work stamping punches high strength sheet metal cobalt hrc",
        "ASP 2042, ASP 2048, ASP 2078",
        '{"co_pct": [">=", 8.0], "hardness_max": [">=", 67.0]}',
    ),
    "15": (
        "Cutting tools broaching and end mills, at least 8% cobalt, at least 65 HRC.",
        [CO75, "hardness_max >= 65.0"],
        "cutting tools broaching end mills cobalt hrc",
        "ASP 2030, Evoloop M42, ASP 2042, ASP 2048, ASP 2078, ASP 2060, ASP 2190",
        '{"co_pct": [">=", 8.0], "hardness_max": [">=", 65.0]}',
    ),
    "16": (
        "Impossible grade requirement: extreme alloy with > 35% cobalt and hardness > 75 HRC.",
        ["co_pct > 35.0", "hardness_max > 75.0"],
        "impossible requirement extreme alloy cobalt hardness hrc",
        "",
        '{"co_pct": [">", 35.0]}',
    ),
    "17": (
        "Impossible grade requirement: zero cobalt steel with > 10% molybdenum and at least 67 HRC.",
        [CO0, "mo_pct > 10.0", "hardness_max >= 67.0"],
        "impossible requirement zero cobalt steel molybdenum hrc",
        "",
        '{"co_pct": ["==", 0.0], "mo_pct": [">", 10.0]}',
    ),
    "18": (
        "Impossible grade requirement: tool steel with hardness > 75 HRC.",
        ["hardness_max > 75.0"],
        "impossible requirement tool steel hardness hrc",
        "",
        '{"hardness_max": [">", 75.0]}',
    ),
}

# Acceptable answers of the cases whose survivors leave no choice to the ranking.
EXPECTED = {
    "01": ["ASP 2012", "ASP 2023"],
    "04": ["ASP 2011", "ASP 2053"],
    "05": ["ASP APZ10"],
    "06": ["ASP 2190"],
    "08": ["ASP 2023"],
    "09": ["ASP 2078"],
    "11": ["ASP 2053", "ASP 2011"],
    "13": ["ASP 2060", "ASP 2078"],
    "14": ["ASP 2042", "ASP 2048", "ASP 2078"],
    "16": [],
    "17": [],
    "18": [],
}
