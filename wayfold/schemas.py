"""Declared schemas; nothing is inferred."""

POI = "source_id string, name string, displayName string, aliases array<string>, category string, confidence double, lat double, lon double, source string, sourceSignalCount int, hasWikiEntry boolean, hasWebPresence boolean"
MERGED_POI = "id string, display_name string, normalizedAliases array<string>, categories array<string>, confidence double, lat double, lng double, sources array<string>, seedScore double"
PREFIX_SEARCH = "sessionId string, prefix string, resultIds array<string>, userLat double, userLng double, timestampMs long"
PLACE_SELECTION = "sessionId string, placeId string, timestampMs long"
COMBO_METRICS = "prefix string, placeId string, sumReciprocalRank double, impressions long, selections long, sumAtSelectionRank long, abandonmentCounter long"
PLACE_METRICS = "placeId string, sumPrefixLenOnFirstAppearance long, countFirstAppearances long, sumPrefixLenOnFirstTop long, countFirstTop long, sumPrefixLenOnSelection long, countSelections long"
PREFIX_RANKING = "prefix string, places array<struct<id:string,score:double>>"
REQUEST = "request_id long, prefix string, top_k int, lat double, lng double, session_id string"
OVERTURE = "id string, names struct<primary:string,rules:array<struct<language:string,value:string>>>, categories struct<primary:string>, confidence double, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, sources array<struct<dataset:string>>, websites array<string>, socials array<string>, brand struct<wikidata:string>"
OSM = "id long, kind string, lat double, lon double, tags map<string,string>"
