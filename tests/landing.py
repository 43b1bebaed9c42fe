"""Small landing files for the tests."""

NYC_LEGACY = ("tripduration,starttime,stoptime,start station id,start station name,start station latitude,"
              "start station longitude,end station id,end station name,end station latitude,"
              "end station longitude,bikeid,usertype,birth year,gender")
NYC_MODERN = ("ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,"
              "end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual")
LONDON_LEGACY = ("Rental Id,Bike Id,Start Date,End Date,StartStation Id,StartStation Name,"
                 "EndStation Id,EndStation Name,Duration")
LONDON_MODERN = ("Number,Start date,Start station number,Start station,End date,End station number,"
                 "End station,Bike number,Bike model,Total duration,Total duration (ms)")


def nyc_legacy(bike, start, stop, station="72", user="Subscriber", born="1985.0"):
    return f'600,{start},{stop},{station},"W 52 St, 11 Ave",40.7,-73.9,79,Franklin,40.71,-74.0,{bike},{user},{born},1'


def nyc_modern(ride, start, stop, station="5", user="member"):
    return f"{ride},classic_bike,{start},{stop},First,{station},Second,6,40.7,-73.9,40.8,-74.0,{user}"


def london_legacy(ride, start, stop, station="14"):
    return f'{ride},77,{start},{stop},{station},"Belgrove Street , King\'s Cross",20,Drummond,600'


def london_modern(ride, start, stop, station="1054"):
    return f"{ride},{start},{station},Holborn,{stop},300,Strand,501,CLASSIC,10m 0s,600000"


def put(root, name, header, *rows):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n")
    return path
