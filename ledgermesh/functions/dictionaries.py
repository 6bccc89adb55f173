"""Fixed values of the classifier: categories, keywords, commodities, links of industries."""

# Category -> industry code.
CATEGORIES = {
    "423310": ["lumber & building materials", "lumber supply", "building materials", "lumber"],
    "423320": ["concrete & masonry supply", "concrete supply", "masonry supply", "concrete"],
    "423710": ["hardware & fasteners", "hardware supply", "hardware store", "hardware"],
    "423720": ["plumbing supply", "plumbing materials", "plumbing wholesale"],
    "423610": ["electrical supply", "electrical materials", "electrical wholesale"],
    "423730": ["hvac supply & equipment", "hvac supply", "hvac equipment", "hvac"],
    "424950": ["paint & coatings", "paint supply", "paint store", "paint"],
    "423330": ["roofing materials", "roofing supply", "roofing"],
    "423220": ["flooring supply", "flooring materials", "flooring"],
    "532412": ["equipment rental", "tool rental", "construction equipment rental"],
    "423810": ["tool & equipment sales", "tool sales"],
    "238220": ["plumbing contractor", "plumbing services", "plumbing", "plumber", "hvac contractor", "hvac services", "heating and cooling"],
    "238210": ["electrical contractor", "electrical services", "electrician"],
    "236220": ["general contractor", "general contracting", "commercial building", "commercial construction", "construction"],
    "236118": ["residential construction", "home building", "home builder"],
    "561730": ["landscaping", "lawn and garden", "lawn care", "landscape design"],
    "562111": ["waste management", "waste removal", "dumpster rental", "debris removal"],
    "238110": ["concrete contractor", "concrete work", "foundation work"],
    "238310": ["insulation", "insulation contractor", "drywall", "drywall contractor"],
    "337110": ["cabinet & millwork", "cabinetry", "custom cabinets", "millwork"],
    "423390": ["window & door", "windows and doors"],
    "423450": ["safety equipment", "safety supply", "ppe supply"],
    "424120": ["office supplies", "office supply"],
    "424710": ["fuel & gas", "fuel supply"],
    "531210": ["homeowner", "residential", "residential owner", "real estate", "real estate investor", "real estate investment"],
    "531311": ["property management", "property manager", "apartment management"],
    "813990": ["hoa", "community association", "homeowners association"],
    "813110": ["church", "religious organization", "house of worship"],
    "611110": ["school", "education", "academy"],
    "921110": ["municipal", "city government", "public works"],
    "722511": ["restaurant", "food service"],
    "452210": ["retail", "retail store"],
    "541410": ["interior design", "interiors"],
    "541512": ["tech company", "technology", "software"],
    "621111": ["healthcare", "medical"],
    "621210": ["dental"],
}
# Keyword -> industry code.
KEYWORDS = {
    "423310": "lumber plywood framing", "423320": "concrete rebar masonry", "423710": "hardware fastener", "238220": "plumbing hvac", "423720": "pipe faucet",
    "238210": "electrical", "423610": "wire conduit", "423730": "ductwork furnace", "424950": "paint coating stain", "423330": "roofing shingle gutter",
    "423220": "flooring tile carpet", "532412": "rental excavator scaffold", "561730": "landscaping lawn irrigation", "562111": "waste dumpster debris",
    "337110": "cabinet millwork", "238310": "insulation drywall", "423390": "window door", "236220": "construction contractor", "236118": "builder",
    "531311": "property", "531210": "realty", "722511": "restaurant", "813110": "church", "611110": "school", "621111": "medical", "621210": "dental", "541512": "software",
}
# Commodities by kind, in order of declaration.
COMMODITIES = {
    "Materials": "lumber,plywood,concrete,rebar,shingles,drywall,pipe,pvc pipe,copper fitting,wire,conduit,paint,stain,tile,carpet,vinyl,hardwood,insulation,mortar,blocks,flashing,underlayment,framing materials,osb sheathing,water heater,fixtures",
    "Equipment": "excavator,skid steer,scaffolding,generators,power tools,saws,drills,compressors,ductwork,ac units,furnaces,thermostats,breaker panels,lighting fixtures",
    "Services": "plumbing installation,pipe repair,water heater install,wiring,electrical installation,panel upgrade,hvac installation,duct cleaning,roofing installation,roof repair,flooring installation,excavation,grading,demolition,lawn maintenance,landscape design,irrigation",
    "Waste": "dumpster,debris removal,waste hauling,roll-off",
    "Supplies": "screws,nails,bolts,anchors,hand tools,ppe,safety equipment,office supplies",
    "General": "plumbing,electrical,hvac,roofing,flooring,landscaping",
}
TRADES = "plumbing electrical hvac roofing flooring landscaping concrete lumber paint".split()
# Industries that share a commodity.
CROSS_LINKS = [
    ("423720", "238220", "PLB-001"), ("423610", "238210", "ELC-001"), ("423730", "238220", "HVC-001"), ("423310", "238130", "LBR-001"), ("423310", "236220", "LBR-002"),
    ("327320", "238110", "CON-001"), ("423950", "238320", "PNT-001"), ("423330", "238160", "ROF-001"), ("423710", "236220", "HDW-001"), ("331110", "238120", "STL-001"),
    ("327211", "238150", "GLS-001"), ("327993", "238310", "INS-001"), ("444220", "561730", "LND-001"), ("424120", "561110", "OFS-001"), ("423850", "561720", "JAN-001"),
]
# Legal forms at the end of a name.
SUFFIXES = "LIMITED LIABILITY COMPANY|LIMITED LIABILITY CO|INCORPORATED|CORPORATION|COMPANY|LLC|INC|CORP|CO|LTD|LP|LLP|PLLC|PC|PA|DBA"

CATEGORY_CODE = {w: code for code, words in CATEGORIES.items() for w in words}
KEYWORD_CODE = {w: code for code, words in KEYWORDS.items() for w in words.split()}
COMMODITY_KIND = {w: k for k, ws in reversed(COMMODITIES.items()) for w in ws.split(",")}
COMMODITY_ORDER = [w for ws in COMMODITIES.values() for w in ws.split(",")]
