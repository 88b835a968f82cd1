"""Hardware category dictionary of the event-log messages."""

# Category token -> id. Anything else gets the next free id.
CATEGORY_IDS = {
    "Memory": 0,
    "System": 1,
    "Processor": 2,
    "Temperature": 3,
    "Drive": 4,
    "Power": 5,
    "Unknown": 6,
    "Microcontroller": 7,
    "OS": 8,
    "Watchdog2": 9,
    "OEM": 10,
    "Button": 11,
    "Slot/Connector": 12,
    "Microcontroller/Coprocessor": 13,
    "Management": 14,
    "Event": 15,
    "Watchdog": 16,
    "Slot": 17,
    "Fan": 18,
    "Critical": 19,
    "device": 20,
    "LAN": 21,
    "Version": 22,
    "Add-in": 23,
    "Terminator": 24,
    "Chassis": 25,
    "reserved": 26,
    "Physical": 27,
    "Session": 28,
    "Reserved": 29,
    "Cable/Interconnect": 30,
    "Cable": 31,
    "Chip": 32,
    "Battery": 33,
}
UNKNOWN_CATEGORY = len(CATEGORY_IDS)
